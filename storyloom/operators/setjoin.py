"""Pairs of like sets within a time window, counted in units of bounded size.

Rows are dealt to steps of time, some to a window, and a step of many rows to parts by hash: a unit holds the rows of one part, at most HELD on
average, and every row that asks passes it in a stream. So a row is copied a few times, whatever its set's size, and no pair is shuffled. In a
unit a frequent token is a row of flags over the rows held, a rare one a list of them; adding these up counts what a row shares with all of
them. Every two rows of a window meet, so no pair is lost; the time grows with the pairs of rows in a window, at about a nanosecond each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a window, fewer from so many rows on, rows held in a unit, and partitions at most.
STEPS, FEW_STEPS, MANY, HELD, TASKS = 4, 2, 1_000_000, 65_536, 2000
#: Rows held that are counted at a time, rows that ask at a time, share of the rows from which on a token is a row of flags, pairs given out at a time.
BLOCK, ASKING, SPARSE, GIVEN = 16_384, 32, 64, 50_000
#: More than any set has in common.
NEVER = 65_535


def dealt(rows: DataFrame, span: int, both: bool, held: Column | None = None) -> DataFrame:
    """(unit, asks, and the columns of rows): rows (at, no, hit, ...) dealt to units, in each of which those that are held come first.

    With `both`, rows with `hit` ask, for what lies on both sides of them, and rows where `held` are held; else all rows ask what comes after them.
    """
    many = rows.count()
    steps = STEPS if many <= MANY else FEW_STEPS
    bucket = F.floor(F.col("at") / F.lit(max(1, -(-span // steps))))
    rows = rows.withColumn("bucket", bucket)
    kept = rows if held is None else rows.where(held)
    sizes, first = [], 0
    for r in kept.groupBy("bucket").count().orderBy("bucket").collect():  # a row for each step of time
        parts = -(-r["count"] // HELD)
        sizes.append((r["bucket"], parts, first))
        first += parts
    units = F.broadcast(rows.sparkSession.createDataFrame(sizes, "bucket long, parts int, first int"))
    cols = [c for c in rows.columns if c != "bucket"]
    kept = kept.join(units, "bucket").select((F.col("first") + F.pmod(F.xxhash64("no"), F.col("parts"))).cast("int").alias("unit"), F.lit(False).alias("asks"), *cols)
    asks = (rows.where("hit") if both else rows).withColumn("bucket", F.explode(F.sequence(F.col("bucket") - (steps if both else 0), F.col("bucket") + steps))).join(units, "bucket")
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select((F.col("first") + F.col("part")).cast("int").alias("unit"), F.lit(True).alias("asks"), *cols)
    tasks = max(1, min(first, TASKS))
    return kept.unionByName(asks).repartitionById(tasks, F.pmod("unit", F.lit(tasks)).cast("int")).sortWithinPartitions("unit", "asks")


def in_units(batches: Iterator[pa.RecordBatch], build: Callable, answer: Callable) -> Iterator[pa.RecordBatch]:
    """answer(build(rows held), rows that ask) for each unit, piece by piece."""
    unit, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        units, asks = batch.column("unit").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((units[1:] != units[:-1]) | (asks[1:] != asks[:-1])) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.slice(a, b - a)
            if units[a] != unit:
                unit, held, block = units[a], [], None
            if not asks[a]:
                held.append(piece)
            elif held:
                block = block or build(pa.Table.from_batches(held))
                yield from answer(block, piece)


def _flat(column: pa.Array | pa.ChunkedArray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, size, several) of lists in order: each token of a row once, the sizes with repeats, and whether a row has any."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = rows if order is None else rows.take(pa.array(order))
    size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, token = np.repeat(np.arange(len(rows)), size), rows.flatten().to_numpy(zero_copy_only=False)
    several = np.zeros(len(rows), dtype=bool)
    again = np.flatnonzero((row[1:] == row[:-1]) & (token[1:] == token[:-1])) + 1  # the lists are in order
    if again.size:
        several[row[again]] = True
        row, token = np.delete(row, again), np.delete(token, again)
    return row, token, size, several


class Postings:
    """The sets of some rows, by token."""

    def __init__(self, row: np.ndarray, token: np.ndarray, n: int, kind: type) -> None:
        self.n, self.kind = n, kind
        self.tokens, place = np.unique(token, return_inverse=True)
        self.rows = row[np.argsort(place, kind="stable")]
        self.df = np.bincount(place, minlength=len(self.tokens))
        self.start = np.cumsum(self.df) - self.df
        often = np.flatnonzero(self.df * SPARSE >= n)
        self.flag = np.full(len(self.tokens), -1)
        self.flag[often] = np.arange(len(often))
        self.flags = np.zeros((len(often), n), dtype=kind)
        at = np.flatnonzero(self.flag[place] >= 0)
        self.flags[self.flag[place[at]], row[at]] = 1

    def asked(self, row: np.ndarray, token: np.ndarray, asks: int) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
        """Of tokens of rows that ask: rows and places of the rare ones here, rows of flags of the others with their offsets by row."""
        if not len(self.tokens):
            return row[:0], row[:0], [], np.zeros(asks + 1, dtype=np.int64)
        place = np.minimum(np.searchsorted(self.tokens, token), len(self.tokens) - 1)
        here = self.tokens[place] == token
        row, place = row[here], place[here]
        often = self.flag[place] >= 0
        return row[~often], place[~often], self.flag[place[often]].tolist(), np.searchsorted(row[often], np.arange(asks + 1))

    def counts(self, asked: tuple, a: int, b: int, lo: list, hi: list) -> np.ndarray:
        """What each of the rows a to b that ask shares with each row here, from lo to hi of each."""
        rare_row, rare, flag, offsets = asked
        out = np.zeros((b - a, self.n), dtype=self.kind)
        x, y = np.searchsorted(rare_row, (a, b))
        if y > x:
            df = self.df[rare[x:y]]
            ends = np.cumsum(df)
            at = np.repeat(self.start[rare[x:y]] - ends + df, df) + np.arange(ends[-1])
            np.add.at(out.reshape(-1), np.repeat((rare_row[x:y] - a) * self.n, df) + self.rows[at], self.kind(1))
        for k in range(a, b):
            if lo[k] < hi[k]:
                sums = out[k - a, lo[k] : hi[k]]
                for f in flag[offsets[k] : offsets[k + 1]]:
                    np.add(sums, self.flags[f, lo[k] : hi[k]], out=sums)
        return out


class Block:
    """Some rows held, in order of time, with postings for each of their sets and the numbers that classes of theirs have."""

    def __init__(self, table: pa.Table, sets: list[str], of: np.ndarray) -> None:
        at, no = table.column("at").to_numpy()[of], table.column("no").to_numpy()[of]
        order = np.lexsort((no, at))
        self.of, self.at, self.no, self.cache = of[order], at[order], no[order], {}
        self.cold = ~table.column("hit").to_numpy()[self.of]
        self.sets, self.size, self.several = {}, {}, {}
        for s in sets:
            row, token, self.size[s], self.several[s] = _flat(table.column(s), self.of)
            kind = np.uint8 if np.bincount(row, minlength=1).max() < 255 else np.uint16
            self.sets[s] = Postings(row, token, len(of), kind)

    def window(self, at: np.ndarray, no: np.ndarray, span: int, both: bool) -> tuple[list, list, list]:
        """(lo, own, hi) for each row that asks: where its window begins, what comes after it, where its window ends."""
        own = np.searchsorted(self.at, at, "left")
        for k in np.flatnonzero(np.searchsorted(self.at, at, "right") > own):
            end = np.searchsorted(self.at, at[k], "right")
            own[k] += np.searchsorted(self.no[own[k] : end], no[k], "right")
        lo = np.searchsorted(self.at, at - span, "left") if both else own
        return lo.tolist(), own.tolist(), np.searchsorted(self.at, at + span, "right").tolist()

    def needed(self, name: str, n: int, key: object, table: Callable[[], np.ndarray]) -> np.ndarray:
        """What each row here must share with a set of n: a table by the smaller size, made once for each key."""
        if (found := self.cache.get((name, n, key))) is None:
            if len(self.cache) >= 512:
                self.cache.clear()
            by = table()
            found = by[np.minimum(np.minimum(n, self.size[name]), len(by) - 1)]
            self.cache[name, n, key] = found = np.minimum(found, np.iinfo(self.sets[name].kind).max).astype(self.sets[name].kind)
        return found


def times(left: list, right: list, least: float) -> int:
    """How often two lists of numbers with repeats meet: at places of the first number that both have, within the prefix of the smaller list."""
    need = int(np.ceil(np.float64(least - 5e-7) * len(left)))
    key = min(set(left) & set(right))
    return sum(1 for p, x in enumerate(left) if x == key and p <= len(left) - need) * sum(1 for p, x in enumerate(right) if x == key and len(right) - p >= need)


def repeats(a: list, b: list, ids: tuple, least: float) -> int:
    """times() of the set of a row that asks and of one held, the smaller one first, or that with the smaller id."""
    return times(b, a, least) if len(b) < len(a) or (len(a) == len(b) and ids[1] < ids[0]) else times(a, b, least)


class Unit:
    """The rows held of a unit, in blocks along the times, or along the order `by`."""

    def __init__(self, held: pa.Table, sets: list[str], by: str | None = None) -> None:
        self.table = held.combine_chunks()
        order = np.lexsort((held.column("no").to_numpy(), held.column("at").to_numpy())) if by is None else pc.sort_indices(held.column(by), null_placement="at_start").to_numpy()
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.blocks = [Block(self.table, sets, order[k : k + BLOCK]) for k in range(0, len(order), BLOCK)]

    def take(self, name: str, of: np.ndarray) -> pa.Array:
        return pa.concat_arrays(self.table.column(name).take(pa.array(of)).chunks)


def like_pairs(rows: DataFrame, span: int, least: float, classes: list[str], carried: list[str], both: bool, keep: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """(id_a, id_b, n_a, n_b, shared, n_<class> of each, and c_a, c_b of each carried column c): every two rows (id, at, no, hit, t, ...) within
    the span that share `least` of the smaller set t, once. With `both` only pairs that have a row with `hit`. classes: columns with subsets of t.
    keep(n, shared, and n of each class) says which pairs are given out, n the size of the smaller set."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ["id_a", "id_b", "n_a", "n_b", "shared", *(f"n_{c}" for c in classes), *(f"{c}_{p}" for c in carried for p in "ab")]
    schema = f"id_a {kinds['id']}, id_b {kinds['id']}, n_a int, n_b int, shared int" + "".join(f", n_{c} int" for c in classes) + "".join(f", `{c}_{p}` {kinds[c]}" for c in carried for p in "ab")

    def needs(most: int) -> np.ndarray:
        return np.array([NEVER, *(max(1, int(np.ceil(np.float64(least - 5e-7) * n))) for n in range(1, most + 1))])

    def answer(unit: Unit, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat = {c: _flat(piece.column(c)) for c in ("t", *classes)}
        at, no, size = piece.column("at").to_numpy(), piece.column("no").to_numpy(), flat["t"][2]
        for block in unit.blocks:
            lo, own, hi = block.window(at, no, span, both)
            if not any(x < y for x, y in zip(lo, hi)):
                continue
            post, most = block.sets["t"], int(block.size["t"].max(initial=0))
            asked = {c: post.asked(*flat[c][:2], piece.num_rows) for c in flat}
            found: list[tuple] = []
            pairs = 0
            for a in range(0, piece.num_rows, ASKING):
                b = min(a + ASKING, piece.num_rows)
                sums = post.counts(asked["t"], a, b, lo, hi)
                of = [post.counts(asked[c], a, b, lo, hi) if asked[c][0].size or asked[c][2] else None for c in classes]
                for k in range(a, b):
                    x, y = lo[k], hi[k]
                    if x >= y or not size[k]:
                        continue
                    met = sums[k - a, x:y] >= block.needed("t", int(size[k]), None, lambda: needs(most))[x:y]
                    if both:
                        met[: own[k] - x] &= block.cold[x : own[k]]
                    if (at_h := np.flatnonzero(met) + x).size:
                        found.append((np.full(at_h.size, k), at_h, sums[k - a, at_h], *(np.zeros(at_h.size, np.uint8) if s is None else s[k - a, at_h] for s in of)))
                        pairs += at_h.size
                if found and (pairs >= GIVEN or b == piece.num_rows):
                    yield from given(unit, block, piece, size, flat["t"][3], [np.concatenate(x) for x in zip(*found)])
                    found, pairs = [], 0

    def given(unit: Unit, block: Block, piece: pa.RecordBatch, size: np.ndarray, several: np.ndarray, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if keep is not None:
            stay = keep(np.minimum(size[found[0]], block.size["t"][found[1]]), *(f.astype(np.int64) for f in found[2:]))
            found = [f[stay] for f in found]
        odd = np.flatnonzero(several[found[0]] | block.several["t"][found[1]])
        if odd.size:
            k, h = found[0][odd], block.of[found[1][odd]]
            sides = zip(*(x.to_pylist() for x in (piece.column("t").take(pa.array(k)), unit.take("t", h), piece.column("id").take(pa.array(k)), unit.take("id", h))))
            count = np.ones(len(found[0]), dtype=np.int64)
            count[odd] = [repeats(t, u, (i, j), least) if i != j else 0 for t, u, i, j in sides]
            found = [np.repeat(x, count) for x in found]
        for x in range(0, len(found[0]), GIVEN):
            k, h, *shared = (f[x : x + GIVEN] for f in found)
            col = lambda c: [piece.column(c).take(pa.array(k)), unit.take(c, block.of[h])]
            numbers = [pa.array(v.astype(np.int32)) for v in (size[k], block.size["t"][h], *shared)]
            yield pa.RecordBatch.from_arrays([*col("id"), *numbers, *(v for c in carried for v in col(c))], names=out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_units(batches, lambda held: Unit(held, ["t"]), answer)

    return dealt(rows, span, both).mapInArrow(work, schema)


def covering(rows: DataFrame, span: int, least: float, both: bool, best: int | None = None) -> DataFrame:
    """(a, b, similarity): rows (at, no, hit, w, b) within the span whose sets w, or else b, overlap by `least` of the smaller one, with the larger
    share of the two, in three digits.

    Without `both` every two rows (id) once. With it a row with `hit` (id_a) and one without (id_b), and where `best` is given at least so many
    of those that are most alike in each unit, ties to the smallest id_b: the best of all are among them.
    """
    left, right = ("id_a", "id_b") if both else ("id", "id")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    distinct, prefix = kinds[left] == kinds[right], least - 0.0005
    lowest = next(c for c in range(1002) if c / 1000 >= least)

    def share(shared: np.ndarray, n: np.ndarray) -> np.ndarray:
        """In thousandths, halves up."""
        return np.where(n > 0, (2000 * shared + n) // np.maximum(2 * n, 1), 0)

    def needs(bound: int, most: int) -> np.ndarray:
        n = np.arange(most + 1)
        shared = np.maximum(1, (bound * 2 * n - n + 1999) // 2000)  # the fewest that give a share of `bound`
        return np.where((n > 0) & (share(shared, n) >= bound), np.maximum(shared, np.ceil((prefix - 5e-7) * n).astype(np.int64)), NEVER)

    def answer(unit: Unit, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat = {s: _flat(piece.column(s)) for s in "wb"}
        at, no = piece.column("at").to_numpy(), piece.column("no").to_numpy()
        own, ids = piece.column(left).to_pylist(), unit.table.column(right).to_pylist() if distinct else None
        bound, kept, found, pairs = [lowest] * piece.num_rows, {}, [], 0
        for block in unit.blocks:
            lo, _, hi = block.window(at, no, span, both)
            hi = [y if c <= 1000 else x for x, y, c in zip(lo, hi, bound)]
            if not any(x < y for x, y in zip(lo, hi)):
                continue
            most = {s: int(block.size[s].max(initial=0)) for s in "wb"}
            asked = {s: block.sets[s].asked(*flat[s][:2], piece.num_rows) for s in "wb"}
            for a in range(0, piece.num_rows, ASKING):
                b = min(a + ASKING, piece.num_rows)
                sums = {s: block.sets[s].counts(asked[s], a, b, lo, hi) for s in "wb"}
                for k in range(a, b):
                    x, y = lo[k], hi[k]
                    n = {s: int(flat[s][2][k]) for s in "wb"}
                    met = [sums[s][k - a, x:y] >= block.needed(s, n[s], bound[k], lambda: needs(bound[k], most[s]))[x:y] for s in "wb" if n[s]] if x < y else []  # noqa: B023
                    if not met or not (h := np.flatnonzero(met[0] | met[-1]) + x).size:
                        continue
                    w, c = (share(sums[s][k - a, h].astype(np.int64), np.minimum(n[s], block.size[s][h])) for s in "wb")
                    c, of = np.maximum(w, c), block.of[h]
                    if distinct:
                        other = np.flatnonzero([ids[i] != own[k] for i in of])
                        h, w, c, of = h[other], w[other], c[other], of[other]
                    odd = np.flatnonzero(flat["w"][3][k] | flat["b"][3][k] | block.several["w"][h] | block.several["b"][h])
                    if odd.size:
                        count = np.ones(len(h), dtype=np.int64)
                        for i in odd:
                            s = "w" if w[i] >= lowest else "b"
                            tie = (1, 0) if both else (own[k], ids[of[i]])
                            count[i] = repeats(piece.column(s)[k].as_py(), unit.table.column(s)[int(of[i])].as_py(), tie, prefix)
                        c, of = np.repeat(c, count), np.repeat(of, count)
                    if not best:
                        found.append((np.full(len(of), k), of, c))
                        pairs += len(of)
                        continue
                    if len(of) > best:
                        some = np.flatnonzero(c >= np.partition(c, len(c) - best)[len(c) - best])
                        of, c = of[some], c[some]
                    if k in kept:
                        of, c = np.concatenate((kept[k][0], of)), np.concatenate((kept[k][1], c))
                    order = np.lexsort((unit.rank[of], -c))[:best]
                    kept[k] = of[order], c[order]
                    if len(order) == best:  # blocks come by id, so what follows must be more alike
                        bound[k] = int(c[order[-1]]) + 1
                if pairs >= GIVEN:
                    yield from given(unit, piece, found)
                    found, pairs = [], 0
        yield from given(unit, piece, found + [(np.full(len(of), k), of, c) for k, (of, c) in kept.items()])

    def given(unit: Unit, piece: pa.RecordBatch, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        k, of, c = (np.concatenate(x) for x in zip(*found)) if found else ([], [], [])
        for x in range(0, len(k), GIVEN):
            y = x + GIVEN
            yield pa.RecordBatch.from_arrays([piece.column(left).take(pa.array(k[x:y])), unit.take(right, of[x:y]), pa.array(c[x:y] / 1000)], names=["a", "b", "similarity"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_units(batches, lambda held: Unit(held, ["w", "b"], right if best else None), answer)

    return dealt(rows, span, both, ~F.col("hit") if both else None).mapInArrow(work, f"a {kinds[left]}, b {kinds[right]}, similarity double")
