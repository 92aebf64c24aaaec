"""Repeated windows across a corpus, by winnowed seeds.

A window is a fixed number of consecutive units (bytes or words) of one text. Of the hashes of the shorter
seeds in each window the smallest is chosen, so equal windows choose the same seed, wherever they stand.

1. ``parts``: texts are dealt out by a hash of ``doc_id``; each part is worked on as a whole. All later steps
   read the same exchange.
2. ``found_again``: which seeds stand at more than one place. Only five bytes of a seed's hash travel; a false
   agreement costs work and changes nothing.
3. ``neighbourhoods``: such seeds meet again with a hash of all units that any window over them can reach.
   Where an equal neighbourhood stands earlier, all windows over the seed are repeats. A neighbourhood that is
   the first of its kind, of a seed with several kinds, stays open: some of its windows may be repeats.
4. ``open_windows``: the units of open neighbourhoods meet by seed; a given function compares them.

Copies meet early: of equal neighbourhoods within a part only the first travels, the others are decided in
place. So the records of a seed number at most its parts times its distinct neighbourhoods. What travels are
packed arrays, one row for each part and bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.llm.units import BYTE, SLICE_BYTES, Runs, U, Words, flat, mix, slices, slide

LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Windows:
    """Units of a window and of a seed; whether an earlier place in the same document counts."""

    width: int
    seed: int
    words: bool
    same_text: bool

    def units(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the units, and where each text's begin."""
        if self.words:
            words = Words(buf, at)
            return words.hash, words.at
        return BYTE[buf], at


def pack(a: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of all of them, which compresses well."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pack_places(doc: np.ndarray, pos: np.ndarray) -> dict[str, bytes]:
    """Places in ascending order as differences."""
    step = np.diff(doc, prepend=0)
    same = np.zeros(len(doc), bool)
    same[1:] = step[1:] == 0
    before = np.concatenate([[0], pos[:-1]]) if len(pos) else pos
    return {"docs": pack(step), "places": pack(np.where(same, pos - before, pos))}


def unpack_places(docs: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    doc, pos = np.cumsum(unpack(docs)), unpack(places)
    if len(doc):
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        sums = np.cumsum(pos)
        base = (sums - pos)[first]
        pos = sums - base[np.cumsum(first) - 1]
    return doc, pos


def parts(docs: DataFrame, number: int, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``text`` and the columns to carry along, dealt into parts; a null ``doc_id`` is a value like any other."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    return own.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(number)).cast("int")).repartition(number, "part")


def in_order(table: pa.Table) -> pa.Table:
    """The texts of a part in an order that does not depend on how they came."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def part_of(table: pa.Table) -> int:
    return table.column("part")[0].as_py()


class Slice:
    """Some texts of a part: units, their texts and the hashes of runs."""

    def __init__(self, kind: Windows, first: int, buf: np.ndarray, at: np.ndarray):
        self.kind, self.first = kind, first
        self.values, self.at = kind.units(buf, at)
        self.doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        self.runs = Runs(self.values)

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the chosen seeds."""
        kind, n = self.kind, len(self.values)
        if n < kind.width:
            return np.zeros(0, np.int64), np.zeros(0, U)
        ends = self.at[1:][self.doc]
        own = self.runs.windows(kind.seed)
        order = mix(own)
        here = np.arange(n)
        order[here[: len(order)] + kind.seed > ends[: len(order)]] = np.iinfo(np.uint64).max
        span = kind.width - kind.seed + 1
        least = slide(order, span, np.minimum)
        least[here[: len(least)] + kind.width > ends[: len(least)]] = 0
        held = np.zeros(len(order) + span - 1, U)
        held[span - 1 : span - 1 + len(least)] = least
        at = np.nonzero(slide(held, span, np.maximum)[: len(order)] == order)[0]
        return at, order[at]

    def neighbourhood(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First unit and end of what any window over the seeds at these places can reach."""
        doc = self.doc[at]
        return np.maximum(at - (self.kind.width - self.kind.seed), self.at[doc]), np.minimum(at + self.kind.width, self.at[doc + 1])


def slices_of(kind: Windows, table: pa.Table) -> Iterator[Slice]:
    buf, at = flat(table.column("text"))
    for i, _, data, places in slices(buf, at, SLICE_BYTES):
        yield Slice(kind, i, data, places)


def by_bucket(bucket: np.ndarray, number: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(number + 1))
    for b in range(number):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, the last one least; and whether an entry in that order begins a new group."""
    order = np.lexsort(keys[::-1])
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, fresh


def table_of(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


_binary = pa.binary()
PLACE_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("docs", _binary), ("places", _binary)])
PLACE_DDL = "part int, kind int, docs binary, places binary"
SEED_SCHEMA = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("keys", _binary), ("known", _binary), ("docs", _binary), ("places", _binary)])
SEED_DDL = "bucket int, part int, keys binary, known binary, docs binary, places binary"
AREA_SCHEMA = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("keys", _binary), ("areas", _binary), ("ids", _binary), ("docs", _binary), ("places", _binary)])
AREA_DDL = "bucket int, part int, keys binary, areas binary, ids binary, docs binary, places binary"
OPEN_SCHEMA = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("keys", _binary), ("ids", _binary), ("left", _binary), ("length", _binary), ("units", _binary), ("docs", _binary), ("places", _binary)])
OPEN_DDL = "bucket int, part int, keys binary, ids binary, left binary, length binary, units binary, docs binary, places binary"

#: Kinds of places: a seed that stands elsewhere too; one whose neighbourhood is a repeat; one that is open; a
#: window that is a repeat.
SEED, WHOLE, OPEN, WINDOW = range(4)


def found_again(dealt: DataFrame, kind: Windows, number: int) -> DataFrame:
    """Places of the seeds that stand at more than one place, by part."""

    def sketch(table: pa.Table) -> pa.Table:
        part = part_of(table)
        keys, docs, places = [], [], []
        for x in slices_of(kind, in_order(table)):
            at, key = x.seeds()
            keys.append(key)
            docs.append(x.doc[at] + x.first)
            places.append(at - x.at[x.doc[at]])
        key, doc, pos = map(np.concatenate, (keys, docs, places))
        order, fresh = grouped(key)
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        known, first = np.zeros(len(key), bool), np.zeros(len(key), bool)
        known[order[tied]] = True
        first[order[fresh]] = True
        rows = []
        rest = np.nonzero(~first)[0]
        if len(rest):
            rows.append({"bucket": part % number, "part": part, "keys": b"", "known": b"", **pack_places(doc[rest], pos[rest])})
        own = np.nonzero(first)[0]
        for b, some in by_bucket((key[own] >> U(40)).astype(np.int64) % number, number):
            some = own[some]
            short = key[some].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            rows.append({"bucket": b, "part": part, "keys": short, "known": known[some].tobytes(), **pack_places(doc[some], pos[some])})
        return table_of(rows, SEED_SCHEMA)

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        key = np.zeros((sum(len(r["keys"]) // 5 for r in rows), 8), np.uint8)
        key[:, :5] = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8).reshape(-1, 5)
        key = key.view("<u8").ravel()
        order = np.argsort(key)
        again = np.zeros(len(key), bool)
        same = key[order][1:] == key[order][:-1]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        out, at = [], 0
        for r in rows:
            n = len(r["keys"]) // 5
            if not n:
                out.append({"part": r["part"], "kind": SEED, "docs": r["docs"], "places": r["places"]})
                continue
            hit = again[at : at + n] | np.frombuffer(r["known"], bool)
            at += n
            if hit.any():
                doc, pos = unpack_places(r["docs"], r["places"])
                out.append({"part": r["part"], "kind": SEED, **pack_places(doc[hit], pos[hit])})
        return table_of(out, PLACE_SCHEMA)

    return dealt.groupBy("part").applyInArrow(sketch, SEED_DDL).groupBy("bucket").applyInArrow(meet, PLACE_DDL)


def places_of(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """All places of one kind, in ascending order."""
    got = [unpack_places(r["docs"], r["places"]) for r in table.to_pylist() if r["kind"] == kind]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, pos = map(np.concatenate, zip(*got, strict=True))
    order = np.lexsort((pos, doc))
    return doc[order], pos[order]


def within(x: Slice, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Units of a slice at the given places that lie in it."""
    low, high = np.searchsorted(doc, [x.first, x.first + len(x.at) - 1])
    return x.at[doc[low:high] - x.first] + pos[low:high]


def neighbourhoods(dealt: DataFrame, again: DataFrame, kind: Windows, number: int) -> DataFrame:
    """Places whose neighbourhood is a repeat (``WHOLE``), and open ones (``OPEN``), by part."""

    def gather(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows or not found.num_rows:
            return table_of([], AREA_SCHEMA)
        part, table = part_of(table), in_order(table)
        ids = ids_of(table)
        doc, pos = places_of(found, SEED)
        got = []
        for x in slices_of(kind, table):
            at = within(x, doc, pos)
            low, high = x.neighbourhood(at)
            area = mix(x.runs.of(low, high) ^ mix((high - low).astype(U) * U(1009) + (at - low).astype(U)))
            got.append((mix(x.runs.of(at, at + kind.seed)), area, x.doc[at] + x.first, at - x.at[x.doc[at]]))
        key, area, doc, pos = map(np.concatenate, zip(*got, strict=True))
        order, fresh = grouped(key, area, ids[doc], pos)
        _, fresh = order, np.ones(len(order), bool)
        if len(order):
            fresh[1:] = (key[order][1:] != key[order][:-1]) | (area[order][1:] != area[order][:-1])
        head = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else order
        # Of equal neighbourhoods in a part, a later one is a repeat of the first, unless they share a document
        # and that does not count: then it is in the same case as the first.
        late = ids[doc[order]] > ids[doc[head]]
        if kind.same_text:
            late |= (doc[order] == doc[head]) & (pos[order] > pos[head])
        rows = []
        done = np.sort(order[late])
        if len(done):
            rows.append({"bucket": part % number, "part": part, "keys": b"", "areas": b"", "ids": b"", **pack_places(doc[done], pos[done])})
        own = np.sort(order[~late])
        for b, some in by_bucket((key[own] % U(number)).astype(np.int64), number):
            some = own[some]
            rows.append({"bucket": b, "part": part, "keys": key[some].tobytes(), "areas": area[some].tobytes(), "ids": ids[doc[some]].tobytes(), **pack_places(doc[some], pos[some])})
        return table_of(rows, AREA_SCHEMA)

    def meet(table: pa.Table) -> pa.Table:
        out, rows = [], []
        for r in table.to_pylist():
            if r["keys"]:
                rows.append(r)
            else:
                out.append({"part": r["part"], "kind": WHOLE, "docs": r["docs"], "places": r["places"]})
        if rows:
            key, area = (np.frombuffer(b"".join(r[c] for r in rows), U) for c in ("keys", "areas"))
            ids = np.frombuffer(b"".join(r["ids"] for r in rows), np.int64)
            places = [unpack_places(r["docs"], r["places"]) for r in rows]
            pos = np.concatenate([p for _, p in places])
            order, fresh = grouped(key, area, ids, pos)
            k, a, i = key[order], area[order], ids[order]
            new_key, new_area = np.ones(len(k), bool), np.ones(len(k), bool)
            new_key[1:] = k[1:] != k[:-1]
            new_area[1:] = new_key[1:] | (a[1:] != a[:-1])
            number_of = np.cumsum(new_key) - 1
            kinds = np.bincount(number_of, weights=new_area)[number_of]
            head = np.maximum.accumulate(np.where(new_area, np.arange(len(k)), 0))
            late = i > i[head]
            if kind.same_text:
                late |= (i == i[head]) & (pos[order] > pos[order][head])
            verdict = np.full(len(k), -1)
            verdict[order] = np.where(late, WHOLE, np.where(kinds > 1, OPEN, -1))
            at = 0
            for r, (doc, pos) in zip(rows, places, strict=True):
                own = verdict[at : at + len(doc)]
                at += len(doc)
                for v in (WHOLE, OPEN):
                    if (hit := own == v).any():
                        out.append({"part": r["part"], "kind": v, **pack_places(doc[hit], pos[hit])})
        return table_of(out, PLACE_SCHEMA)

    met = dealt.groupBy("part").cogroup(again.groupBy("part")).applyInArrow(gather, AREA_DDL)
    return met.groupBy("bucket").applyInArrow(meet, PLACE_DDL).repartition(number, "part")


@dataclass
class Open:
    """Open neighbourhoods that met: seed, document, place of the seed, units before it, length, units in rows."""

    key: np.ndarray
    ids: np.ndarray
    pos: np.ndarray
    left: np.ndarray
    length: np.ndarray
    units: np.ndarray


def open_windows(dealt: DataFrame, verdicts: DataFrame, kind: Windows, number: int, compare: Callable[[Open, Windows], np.ndarray]) -> DataFrame:
    """Places of single windows that are repeats (``WINDOW``). ``compare`` marks, for each neighbourhood, the
    repeats among its windows, by the place of their first unit in it."""
    side = kind.width - kind.seed
    reach = side + kind.width
    unit = "<u8" if kind.words else np.uint8

    def gather(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows or not found.num_rows:
            return table_of([], OPEN_SCHEMA)
        part, table = part_of(table), in_order(table)
        ids = ids_of(table)
        doc, pos = places_of(found, OPEN)
        if not len(doc):
            return table_of([], OPEN_SCHEMA)
        buf, at = flat(table.column("text"))
        rows: dict[int, list] = {}
        for i, _, data, places in slices(buf, at, SLICE_BYTES):
            x = Slice(kind, i, data, places)
            here = within(x, doc, pos)
            if not len(here):
                continue
            low, high = x.neighbourhood(here)
            key = mix(x.runs.of(here, here + kind.seed))
            source = x.values if kind.words else data
            taken = low[:, None] + np.arange(reach)[None, :]
            units = np.where(taken < high[:, None], source[np.minimum(taken, len(source) - 1)], 0).astype(unit)
            for b, some in by_bucket((key % U(number)).astype(np.int64), number):
                own = x.doc[here[some]]
                rows.setdefault(b, []).append((key[some], ids[own + x.first], (here - low)[some], (high - low)[some], units[some], own + x.first, here[some] - x.at[own]))
        out = []
        for b, got in rows.items():
            key, own, left, length, units, d, p = map(np.concatenate, zip(*got, strict=True))
            out.append({"bucket": b, "part": part, "keys": key.tobytes(), "ids": own.tobytes(), "left": pack(left), "length": pack(length), "units": units.tobytes(), **pack_places(d, p)})
        return table_of(out, OPEN_SCHEMA)

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        places = [unpack_places(r["docs"], r["places"]) for r in rows]
        met = Open(
            np.frombuffer(b"".join(r["keys"] for r in rows), U), np.frombuffer(b"".join(r["ids"] for r in rows), np.int64),
            np.concatenate([p for _, p in places]), np.concatenate([unpack(r["left"]) for r in rows]), np.concatenate([unpack(r["length"]) for r in rows]),
            np.frombuffer(b"".join(r["units"] for r in rows), unit).reshape(-1, reach),
        )
        marks = compare(met, kind)
        out, at = [], 0
        for r, (doc, pos) in zip(rows, places, strict=True):
            own = marks[at : at + len(doc)]
            entry, first = np.nonzero(own)
            start = pos[entry] - met.left[at : at + len(doc)][entry] + first
            at += len(doc)
            if len(start):
                d = doc[entry]
                order = np.lexsort((start, d))
                d, start = d[order], start[order]
                fresh = np.ones(len(d), bool)
                fresh[1:] = (d[1:] != d[:-1]) | (start[1:] != start[:-1])
                out.append({"part": r["part"], "kind": WINDOW, **pack_places(d[fresh], start[fresh])})
        return table_of(out, PLACE_SCHEMA)

    met = dealt.groupBy("part").cogroup(verdicts.groupBy("part")).applyInArrow(gather, OPEN_DDL)
    return met.groupBy("bucket").applyInArrow(meet, PLACE_DDL)


def repeats(docs: DataFrame, kind: Windows, compare: Callable[[Open, Windows], np.ndarray], finish: Callable[[pa.Table, Iterator[tuple]], pa.Table], ddl: str, carry: Sequence[str] = ()) -> DataFrame:
    """Marks the units that repeated windows cover, and hands each part's texts and marks to ``finish``.

    The columns to carry along are added to the result as they are.
    """
    spark = docs.sparkSession
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts(docs, number, carry)
    ddl = ", ".join([ddl, *(f"`{c}` {dict(docs.dtypes)[c]}" for c in carry)])
    again = found_again(dealt, kind, number)
    verdicts = neighbourhoods(dealt, again, kind, number)
    single = open_windows(dealt, verdicts, kind, number, compare)

    def close(table: pa.Table, found: pa.Table) -> pa.Table:
        table = in_order(table)
        whole, window = places_of(found, WHOLE), places_of(found, WINDOW)
        buf, at = flat(table.column("text"))

        def marked() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            for i, _, data, places in slices(buf, at, SLICE_BYTES):
                x = Slice(kind, i, data, places)
                steps = np.zeros(len(x.values) + 1, np.int32)
                if len(here := within(x, *whole)):
                    low, high = x.neighbourhood(here)
                    np.add.at(steps, low, 1)
                    np.add.at(steps, high, -1)
                if len(here := within(x, *window)):
                    np.add.at(steps, here, 1)
                    np.add.at(steps, here + kind.width, -1)
                yield i, data, places, x.at, np.cumsum(steps)[:-1] > 0

        done = finish(table, marked())
        for c in carry:
            done = done.append_column(c, table.column(c))
        return done

    both = verdicts.unionByName(single.repartition(number, "part"))
    return dealt.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(close, ddl)
