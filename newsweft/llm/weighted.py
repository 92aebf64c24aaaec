"""Near-duplicates by improved consistent weighted sampling.

1. ``shingle_rows``: the five-word shingles of each distinct text with their counts, packed by bucket of the shingle.
2. ``frequencies``: shingles that stand in more than one text, with the number of those texts, packed by part of the text. A text's
   other shingles are only weighed: they can't be shared.
3. ``signatures``: weights are counts times a mild inverse document frequency. A text whose shared shingles weigh less than the
   threshold's share of it has no near-duplicate and is left out, which loses nothing. The others are sampled: the chance that two
   texts draw one sample is their weighted Jaccard similarity.
4. ``candidates``: texts that agree in a band meet. The first one leads; who is not like it by the samples starts a further
   group; every text is compared with all leaders of its bucket. This happens within each part first, so of a large group of copies
   only its leaders go on.
5. ``verified``: the weighted Jaccard similarity of the candidate pairs, from the shingles themselves.
6. ``components``: linked texts form a class, by alternating large-star and small-star steps.
7. ``unlinked``: leaders only save work; a text may fail the exact test with all of them. So in every bucket that still holds more than
   one class, each text is compared with the texts of the other classes that it is like, in cells that hold their shingles. Only links
   that join two classes leave a cell, and step 6 is done once more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.llm.seeds import by_bucket, pack, table_of, unpack
from newsweft.llm.units import BASE, Runs, U, Words, flat, grams, mix, slices
from newsweft.session import durable

SHINGLE, THRESHOLD = 5, 0.8
#: Bands and samples in a band; likeness by samples from which two texts of a bucket are compared exactly.
BANDS, ROWS, LIKE = 14, 3, 0.6
#: Texts of a bucket that one cell of ``unlinked`` holds, besides those of its smaller classes.
CELL = 2000
#: How much heavier the rarest shingle is than one that every text has. It is mild on purpose: the shingles of a large group of
#: copies are frequent, and weighed down strongly they would let a few edits part the group.
RARITY = 0.25

#: Bytes of text whose shingles are packed together.
BLOCK_BYTES = 4_000_000

KEY = np.dtype("V16")
_binary = pa.binary()
BUCKET_DDL = "bucket int, texts binary, sizes binary, keys binary, counts binary"
BUCKET_SCHEMA = pa.schema([("bucket", pa.int32()), *((c, _binary) for c in ("texts", "sizes", "keys", "counts"))])
PART_DDL = "part int, texts binary, sizes binary, keys binary, counts binary, held binary"
PART_SCHEMA = pa.schema([("part", pa.int32()), *((c, _binary) for c in ("texts", "sizes", "keys", "counts", "held"))])
SIGNED_DDL = "text binary, shingles binary, weights binary, total double, keys array<long>, band int, band_key long, samples binary, leader binary"
SIGNED_SCHEMA = pa.schema([
    ("text", _binary), ("shingles", _binary), ("weights", _binary), ("total", pa.float64()), ("keys", pa.list_(pa.int64())), ("band", pa.int32()), ("band_key", pa.int64()), ("samples", _binary), ("leader", _binary),
])


def text_key() -> F.Column:
    """128 bits of a digest tell texts apart; a null text is an empty one."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)), 1, 16)


def split_rows(bucket: np.ndarray, number: int, text: np.ndarray, names: np.ndarray, key: np.ndarray, count: np.ndarray) -> Iterator[dict]:
    """Entries (text, shingle, count) in ascending order of text, as one packed row per bucket."""
    for b, some in by_bucket(bucket, number):
        own, size = np.unique(text[some], return_counts=True)
        yield {"bucket": b, "texts": names[own].tobytes(), "sizes": pack(size), "keys": key[some].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), "counts": pack(count[some])}


def shingle_rows(docs: DataFrame, number: int) -> DataFrame:
    """Buckets of shingles, and (as bucket -1 - part) all shingles' counts of each text."""

    def block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = np.frombuffer(b"".join(batch.column("key").to_pylist()), KEY)
        _, first = np.unique(names, return_index=True)
        first = np.sort(first)
        names = names[first]
        buf, at = flat(batch.column("text").take(pa.array(first)))
        texts, keys, counts = [], [], []
        for i, _, data, places in slices(buf, at):
            words = Words(data, places)
            own, whole = grams(words, SHINGLE)
            size = np.diff(words.at)
            where = np.nonzero(whole)[0]
            short = np.nonzero((size > 0) & (size < SHINGLE))[0]
            few = mix(Runs(words.hash).of(words.at[short], words.at[short + 1]) + size[short].astype(U))
            text, key = np.concatenate([words.doc[where], short]), np.concatenate([own[where], few])
            order = np.lexsort((key, text))
            text, key = text[order], key[order]
            fresh = np.ones(len(text), bool)
            fresh[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
            start = np.nonzero(fresh)[0]
            texts.append(text[start] + i)
            keys.append(key[start])
            counts.append(np.diff(np.append(start, len(text))))
        text, key, count = (np.concatenate(x) for x in (texts, keys, counts))
        rows = list(split_rows((key >> U(40)).astype(np.int64) % number, number, text, names, key, count))
        total = np.bincount(text, count, len(names)).astype(np.int64)
        some = np.nonzero(total)[0]
        for b, own in by_bucket(part_of(names[some], number), number):
            rows.append({"bucket": -1 - b, "texts": names[some[own]].tobytes(), "sizes": pack(total[some[own]]), "keys": b"", "counts": b""})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, BUCKET_SCHEMA)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = flat(batch.column("text"))
            for i, j, _, _ in slices(buf, at, BLOCK_BYTES):
                yield from block(batch.slice(i, j - i))

    rows = docs.select(text_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(sketch, BUCKET_DDL)


def part_of(names: np.ndarray, number: int) -> np.ndarray:
    return (names.view("<u8").reshape(-1, 2)[:, 0] % U(number)).astype(np.int64)


def entries(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of packed rows, and the text, shingle and count of each entry."""
    names = np.frombuffer(b"".join(r["texts"] for r in rows), KEY)
    sizes = np.concatenate([unpack(r["sizes"]) for r in rows]) if rows else np.zeros(0, np.int64)
    key = np.zeros((int(sizes.sum()), 8), np.uint8)
    key[:, :5] = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8).reshape(-1, 5)
    count = np.concatenate([unpack(r["counts"]) for r in rows]) if rows else sizes
    names, which = np.unique(names, return_inverse=True)
    return names, np.repeat(which, sizes), key.view("<u8").ravel(), count


def frequencies(buckets: DataFrame, number: int) -> DataFrame:
    """Shingles of more than one text with the number of texts that hold them (``held``), and the totals, by part of the text."""

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket = rows[0]["bucket"]
        if bucket < 0:
            names = np.frombuffer(b"".join(r["texts"] for r in rows), KEY)
            sizes = np.concatenate([unpack(r["sizes"]) for r in rows])
            _, one = np.unique(names, return_index=True)
            return table_of([{"part": -1 - bucket, "texts": names[one].tobytes(), "sizes": pack(sizes[one]), "keys": b"", "counts": b"", "held": b""}], PART_SCHEMA)
        names, text, key, count = entries(rows)
        order = np.lexsort((text, key))
        text, key, count = text[order], key[order], count[order]
        # A text that came from several blocks counts once.
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        text, key, count = text[fresh], key[fresh], count[fresh]
        start = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
        held = np.diff(np.append(start, len(key)))
        held = np.repeat(held, held)
        again = held > 1
        order = np.argsort(text[again], kind="stable")
        text, key, count, held = (x[again][order] for x in (text, key, count, held))
        out = []
        for b, some in by_bucket(part_of(names, number)[text], number):
            row = next(split_rows(np.zeros(len(some), np.int64), 1, text[some], names, key[some], count[some]))
            # The bucket tells apart what five bytes leave alike.
            whole = mix(key[some] ^ mix(np.full(1, bucket + 1, U))).astype("<u8")
            out.append({"part": b, "texts": row["texts"], "sizes": row["sizes"], "keys": whole.tobytes(), "counts": row["counts"], "held": pack(held[some])})
        return table_of(out, PART_SCHEMA)

    return buckets.groupBy("bucket").applyInArrow(meet, PART_DDL)


def samples(text: np.ndarray, key: np.ndarray, weight: np.ndarray, number: int) -> np.ndarray:
    """Consistent weighted samples, 32 bits each, of texts given by ascending entries: one column for each of BANDS * ROWS draws."""
    start = np.searchsorted(text, np.arange(number))
    out = np.zeros((number, BANDS * ROWS), np.uint32)
    log_weight = np.log(weight)
    part = U((1 << 21) - 1)
    unit = 1.0 / (1 << 21)

    def uniforms(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(((h >> U(s)) & part).astype(np.float64) * unit + unit / 2 for s in (0, 21, 42))

    for k in range(BANDS * ROWS):
        h = mix(key ^ mix(np.array([k + 1], U) * BASE))
        u1, u2, u3 = uniforms(h)
        u4, u5, _ = uniforms(mix(h ^ BASE))
        r = -np.log(u1 * u2)
        t = np.floor(log_weight / r + u5)
        rank = np.log(-np.log(u3 * u4)) - r * (t - u5) - r
        least = np.minimum.reduceat(rank, start)
        at = np.nonzero(rank == least[text])[0]
        first = at[np.concatenate([[True], text[at[1:]] != text[at[:-1]]])]
        out[:, k] = (mix(key[first] ^ mix(t[first].astype(np.int64).astype(U))) >> U(32)).astype(np.uint32)
    return out


def lead(names: np.ndarray, key: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaders among the entries of each bucket, and the pairs of leader and entry that are like each other.

    Of three or more, those lead first whose samples agree most with all others, as an original does with copies edited apart.
    """
    order = np.lexsort((names.view(">u8").reshape(-1, 2)[:, 1], names.view(">u8").reshape(-1, 2)[:, 0], key))
    cuts = np.nonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))[0]
    leaders, left, right = [order[cuts[:-1][np.diff(cuts) == 1]]], [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a == 1:
            continue
        own = order[a:b]
        if len(own) > 2:
            column = drawn[own].astype(U) + (np.arange(BANDS * ROWS).astype(U) << U(32))
            _, which, times = np.unique(column.ravel(), return_inverse=True, return_counts=True)
            own = own[np.argsort(-times[which].reshape(column.shape).sum(axis=1), kind="stable")]
        waits = np.ones(len(own), bool)
        while waits.any():
            head = int(waits.argmax())
            like = (drawn[own] == drawn[own[head]]).mean(axis=1) >= LIKE
            like[head] = False
            waits[head] = False
            waits &= ~like
            leaders.append(own[head : head + 1])
            left.append(np.full(int(like.sum()), own[head]))
            right.append(own[like])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(leaders), np.concatenate(left or none), np.concatenate(right or none)


def band_keys(drawn: np.ndarray) -> np.ndarray:
    """One key for each band; the band is part of it."""
    runs = drawn.astype(U).reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1).astype(U) * BASE, runs.shape[:2])
    for k in range(ROWS):
        keys = mix(keys ^ runs[:, :, k])
    return keys


def signatures(parts: DataFrame, texts: int, threshold: float, number: int) -> DataFrame:
    """Rows of texts that may have a near-duplicate: one with the shingles (``band`` null), one for each band that they lead
    in their part, and pairs of leader and text."""
    scale = RARITY / max(math.log(max(texts, 2)), 1e-9)

    def sign(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        totals = [r for r in rows if not r["keys"]]
        rows = [r for r in rows if r["keys"]]
        if not rows:
            return table_of([], SIGNED_SCHEMA)
        names = np.frombuffer(b"".join(r["texts"] for r in rows), KEY)
        sizes = np.concatenate([unpack(r["sizes"]) for r in rows])
        names, which = np.unique(names, return_inverse=True)
        text = np.repeat(which, sizes)
        key = np.frombuffer(b"".join(r["keys"] for r in rows), "<u8")
        count, held = (np.concatenate([unpack(r[c]) for r in rows]) for c in ("counts", "held"))
        weight = count * (1 + scale * (math.log(max(texts, 2)) - np.log(held)))
        all_names = np.frombuffer(b"".join(r["texts"] for r in totals), KEY)
        all_sizes = np.concatenate([unpack(r["sizes"]) for r in totals])
        order = np.argsort(all_names)
        total = all_sizes[order][np.searchsorted(all_names[order], names)]
        shared = np.bincount(text, weight, len(names))
        own = (total - np.bincount(text, count, len(names))) * (1 + RARITY)
        keep = shared >= threshold * (shared + own) - 1e-9
        entry = keep[text]
        number_of = np.cumsum(keep) - 1
        text, key, weight = number_of[text[entry]], key[entry], weight[entry]
        names, shared, own = names[keep], shared[keep], own[keep]
        if not len(names):
            return table_of([], SIGNED_SCHEMA)
        order = np.lexsort((key, text))
        text, key, weight = text[order], key[order], weight[order]
        # What a text shares with no other is one more shingle of their joint weight.
        lone = np.nonzero(own > 0)[0]
        all_text = np.concatenate([text, lone])
        all_key = np.concatenate([key, mix(names[lone].view("<u8").reshape(-1, 2)[:, 0] ^ BASE)])
        all_weight = np.concatenate([weight, own[lone]])
        order = np.argsort(all_text, kind="stable")
        drawn = np.zeros((len(names), BANDS * ROWS), np.uint32)
        cuts = np.searchsorted(all_text[order], np.arange(len(names) + 1))
        low = 0
        while low < len(names):
            high = max(low + 1, int(np.searchsorted(cuts, cuts[low] + 250_000, "right")) - 1)
            some = order[cuts[low] : cuts[high]]
            drawn[low:high] = samples(all_text[some] - low, all_key[some], all_weight[some], high - low)
            low = high
        keys = band_keys(drawn)
        cuts = np.searchsorted(text, np.arange(len(names) + 1))
        out: list[dict] = []
        raw = names.tobytes()
        name = lambda k: raw[16 * k : 16 * k + 16]
        short, heavy = key.astype("<u4"), weight.astype("<f4")
        for k in range(len(names)):
            a, b = cuts[k], cuts[k + 1]
            sort = np.argsort(short[a:b], kind="stable")
            out.append({"text": name(k), "shingles": short[a:b][sort].tobytes(), "weights": heavy[a:b][sort].tobytes(), "total": float(shared[k] + own[k]), "keys": keys[k].astype(np.int64).tolist(), "samples": drawn[k].tobytes()})
        pairs: set[tuple[int, int]] = set()
        for b in range(BANDS):
            leaders, left, right = lead(names, keys[:, b], drawn)
            pairs.update(zip(left.tolist(), right.tolist(), strict=True))
            for k in leaders.tolist():
                out.append({"text": name(k), "band": b, "band_key": int(keys[k, b].astype(np.int64)), "samples": drawn[k].tobytes()})
        out += [{"text": name(r), "leader": name(q)} for q, r in sorted(pairs)]
        return table_of(out, SIGNED_SCHEMA)

    return parts.groupBy("part").applyInArrow(sign, SIGNED_DDL)


def candidates(signed: DataFrame, number: int) -> DataFrame:
    """Pairs of leader and text, each once."""

    def meet(table: pa.Table) -> pa.Table:
        names = np.frombuffer(b"".join(table.column("text").to_pylist()), KEY)
        drawn = np.frombuffer(b"".join(table.column("samples").to_pylist()), np.uint32).reshape(len(names), -1)
        key = table.column("band_key").to_numpy()
        _, left, right = lead(names, key, drawn)
        raw = names.tobytes()
        pairs = {(raw[16 * a : 16 * a + 16], raw[16 * b : 16 * b + 16]) for a, b in zip(left.tolist(), right.tolist(), strict=True)}
        return pa.table({"leader": pa.array([a for a, _ in pairs], _binary), "text": pa.array([b for _, b in pairs], _binary)})

    far = signed.where(F.col("band").isNotNull()).select("text", "band_key", "samples", F.pmod("band_key", F.lit(number)).alias("deal"))
    met = far.groupBy("deal").applyInArrow(meet, "leader binary, text binary")
    near = signed.where(F.col("leader").isNotNull()).select("leader", "text")
    both = near.unionByName(met)
    return both.select(F.least("leader", "text").alias("a"), F.greatest("leader", "text").alias("b")).where("a <> b").distinct()


def alike_cells(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of each bucket and cell, and of all rows the class, the samples, whether it is of a smaller class (then its rank, else
    -1) and whether this is its own cell."""
    _, root = np.unique(np.frombuffer(b"".join(table.column("root").to_pylist()), KEY), return_inverse=True)
    drawn = np.frombuffer(b"".join(table.column("samples").to_pylist()), np.uint32).reshape(table.num_rows, -1)
    key, cell = table.column("band_key").to_numpy(), table.column("cell").to_numpy()
    minor, home = (np.array(table.column(c).to_pylist(), bool) for c in ("minor", "home"))
    rank = np.unique(np.frombuffer(b"".join(table.column("text").to_pylist()), KEY), return_inverse=True)[1]
    minor = np.where(minor, rank, -1)
    order = np.lexsort((cell, key))
    fresh = (key[order][1:] != key[order][:-1]) | (cell[order][1:] != cell[order][:-1])
    return np.split(order, np.nonzero(fresh)[0] + 1) if len(order) else [], root, drawn, minor, home


def alike_here(drawn: np.ndarray, root: np.ndarray, minor: np.ndarray, k: int, here: np.ndarray, band: int) -> np.ndarray:
    """Rows of ``here`` of other classes that are like row k by their samples and agree with it in no band before this one.

    Two rows of smaller classes go to each other's cell; the one of lesser rank asks.
    """
    rest = here[(root[here] != root[k]) & ((minor[here] < 0) | (minor[here] > minor[k]))]
    equal = drawn[rest] == drawn[k]
    some = rest[equal.mean(axis=1) >= LIKE]
    if not len(some) or not band:
        return some
    early = (drawn[some, : band * ROWS] == drawn[k, : band * ROWS]).reshape(len(some), band, ROWS).all(axis=2).any(axis=1)
    return some[~early]


def unlinked(signed: DataFrame, linked: DataFrame, threshold: float, number: int) -> DataFrame:
    """Links between classes, found by comparing the texts of a bucket that are like each other and not linked yet.

    The largest class of a bucket is cut into cells; all its other texts go to each cell. A pair is compared in the first band
    that it agrees in. Texts with somebody to be compared with bring their shingles to the cell, where they are compared exactly;
    only links that join two classes leave it, so a cell of n texts gives n - 1 at most.
    """
    kind = "text binary, root binary, samples binary, band int, band_key long, minor boolean, cell int, home boolean, deal long"

    def wanted(table: pa.Table) -> pa.Table:
        cells, root, drawn, minor, home = alike_cells(table)
        band, wants = table.column("band").to_numpy(), np.zeros(table.num_rows, bool)
        for own in cells:
            here = own[home[own]]
            for k in own[minor[own] >= 0].tolist():
                some = alike_here(drawn, root, minor, k, here, int(band[k]))
                wants[some] = True
                wants[k] |= len(some) > 0
        return table.filter(pa.array(wants))

    def compare(table: pa.Table) -> pa.Table:
        cells, root, drawn, minor, home = alike_cells(table)
        band, total = table.column("band").to_numpy(), table.column("total").to_numpy()
        names = table.column("text").to_pylist()
        shingles = [np.frombuffer(x, "<u4") for x in table.column("shingles").to_pylist()]
        weights = [np.frombuffer(x, "<f4") for x in table.column("weights").to_pylist()]
        out: list[tuple[bytes, bytes]] = []
        for own in cells:
            join = {int(r): int(r) for r in np.unique(root[own])}

            def top(r: int) -> int:
                while join[r] != r:
                    join[r] = join[join[r]]
                    r = join[r]
                return r

            here = own[home[own]]
            # All shingles of the cell as places of one row of weights.
            sizes = np.array([len(shingles[i]) for i in own])
            _, place = np.unique(np.concatenate([shingles[i] for i in own]), return_inverse=True)
            at = dict(zip(own.tolist(), np.split(place, np.cumsum(sizes)[:-1]), strict=True))
            row = np.zeros(int(place.max(initial=-1)) + 1, np.float32)
            for k in own[minor[own] >= 0].tolist():
                mine = top(int(root[k]))
                some = [j for j in alike_here(drawn, root, minor, k, here, int(band[k])).tolist() if top(int(root[j])) != mine]
                if not some:
                    continue
                row[at[k]] = weights[k]
                ends = np.cumsum([0, *(len(at[j]) for j in some)])
                shared = np.minimum(row[np.concatenate([at[j] for j in some])], np.concatenate([weights[j] for j in some]))
                both = np.add.reduceat(np.append(shared.astype(np.float64), 0.0), ends[:-1])
                row[at[k]] = 0
                for j in np.array(some)[both >= threshold * (total[k] + total[some] - both) - 1e-4].tolist():
                    if top(int(root[j])) != top(int(root[k])):
                        join[top(int(root[j]))] = top(int(root[k]))
                        out.append((names[k], names[j]))
        return pa.table({"a": pa.array([a for a, _ in out], _binary), "b": pa.array([b for _, b in out], _binary)})

    texts = signed.where(F.col("shingles").isNotNull())
    held = texts.select("text", "samples", "keys")
    held = held.join(linked.withColumnRenamed("node", "text"), "text", "left").withColumn("root", F.coalesce("root", "text"))
    sizes = held.select("root", F.explode("keys").alias("band_key")).groupBy("band_key", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band_key").agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("most"))
    mixed = durable(mixed.where("roots > 1").select("band_key", F.ceil(F.col("n") / CELL).cast("int").alias("cells"), F.col("most.root").alias("most")))
    rows = held.select("text", "root", "samples", F.posexplode("keys").alias("band", "band_key")).join(mixed, "band_key")
    rows = rows.withColumns({"minor": F.col("root") != F.col("most"), "own": F.pmod(F.xxhash64("text"), "cells").cast("int")})
    rows = rows.withColumn("cell", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), F.col("cells") - 1)).otherwise(F.array("own"))))
    rows = rows.withColumns({"home": F.col("cell") == F.col("own"), "deal": F.pmod(F.xxhash64("band_key", "cell"), F.lit(4 * number))})
    asked = rows.select(*(c.split()[0] for c in kind.split(", "))).groupBy("deal").applyInArrow(wanted, kind)
    full = asked.join(texts.select("text", "shingles", "weights", "total"), "text")
    return full.groupBy("deal").applyInArrow(compare, "a binary, b binary").distinct()


def verified(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose weighted Jaccard similarity is at least the threshold."""
    held = signed.where(F.col("shingles").isNotNull()).select("text", "shingles", "weights", "total")
    side = lambda c: held.select(F.col("text").alias(c), F.col("shingles").alias(f"{c}_shingles"), F.col("weights").alias(f"{c}_weights"), F.col("total").alias(f"{c}_total"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            cols = [batch.column(c) for c in ("a_shingles", "a_weights", "b_shingles", "b_weights")]
            totals = zip(batch.column("a_total").to_pylist(), batch.column("b_total").to_pylist(), strict=True)
            for k, (p, q) in enumerate(totals):
                sa, wa, sb, wb = (np.frombuffer(c[k].as_buffer(), t) for c, t in zip(cols, ("<u4", "<f4", "<u4", "<f4"), strict=True))
                at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
                both = float(np.where(sb[at] == sa, np.minimum(wa, wb[at]), 0).sum(dtype=np.float64))
                good[k] = both >= threshold * (p + q - both) - 1e-4
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(compare, "a binary, b binary")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the least node that it is linked to."""
    now = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
    before = print_of(now)
    while before[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = durable(small)
        after = print_of(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` and ``class_id``, the least ``doc_id`` of its class, one row per document row.

    Equal texts share a class, and so do texts linked by a weighted Jaccard similarity of at least the threshold. A text of fewer than
    five words has all of them as its one shingle; texts without words are only alike if equal, and a null is an empty text. A null
    ``doc_id`` is counted in no class's least id and gets the class id of its class, null if that has no other. Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text"))
    parts = frequencies(shingle_rows(docs, number), number)
    signed = durable(signatures(parts, docs.count(), threshold, number))
    linked = components(verified(candidates(signed, number), signed, threshold))
    more = durable(unlinked(signed, linked, threshold, number))
    if more.head(1):
        linked = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    least = members.groupBy("text").agg(F.min("doc_id").alias("least"))
    roots = least.join(linked.withColumnRenamed("node", "text"), "text", "left").select("text", "least", F.coalesce("root", "text").alias("root"))
    # A class of one text needs no join; all others take the least id over their texts.
    classes = roots.groupBy("root").agg(F.min("least").alias("class_id"))
    named = roots.join(classes, "root").select("text", "class_id")
    return members.join(named, "text").select("doc_id", "class_id")
