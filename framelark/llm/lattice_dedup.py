"""Embedding near-dedup: E8 lattice hashing in several tables, neighbour probes, exact cosine."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framelark.functions.storage import write_through
from framelark.llm.graph import connected_components
from framelark.llm.lean import lean_map, lean_table
from framelark.llm.packed import mix


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The closest point of E8 (integers, or integers and a half, with an even sum) to each row."""

    def even(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        gap = y - r
        worst = np.abs(gap).argmax(axis=1)
        odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
        r[odd, worst[odd]] += np.where(gap[odd, worst[odd]] >= 0, 1, -1)
        return r

    a, b = even(x), even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def shortest_vectors() -> np.ndarray:
    """The 240 neighbours of the origin: two entries of size 1, or eight of size 1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


class LatticeTables:
    """Cell keys of unit vectors: per table the home cell and the nearest neighbouring cells."""

    def __init__(self, tables: int, probes: int, scale: float, seed: int):
        self.tables, self.probes, self.scale, self.seed = tables, probes, scale, seed
        self.around = shortest_vectors()

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """``int64[n, tables, 1 + probes]``; column 0 is home. A row's keys do not depend on other rows."""
        n, d = unit.shape
        out = np.empty((n, self.tables, 1 + self.probes), np.uint64)
        for t in range(self.tables):
            w = np.random.default_rng((self.seed, t, d)).normal(size=(d, 8)) * self.scale
            p = np.zeros((n, 8))
            for j in range(d):  # fixed order of sums: the same bits in every task
                p += unit[:, j, None] * w[j]
            home = nearest_e8(p)
            gain = np.zeros((n, len(self.around)))
            for j in range(8):
                gain += (p - home)[:, j, None] * self.around[:, j]
            best = np.argsort(-gain, axis=1, kind="stable")[:, : self.probes]
            cells = np.concatenate([home[:, None], home[:, None] + self.around[best]], axis=1)
            h = np.full((n, 1 + self.probes), (t << 32) + d, np.uint64)
            for j in range(8):
                h = mix(h * np.uint64(31) + (cells[:, :, j] * 2).astype(np.int64).view(np.uint64))
            out[:, t] = h
        return out.view(np.int64)


def _units(column) -> np.ndarray:
    """Unit vectors of an Arrow list column of equal lengths, in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    v = values.reshape(len(column), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def lattice_near_dedup(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    tables: int = 8,
    probes: int = 4,
    scale: float = 1.0,
    seed: int = 8,
    unit_rows: int = 2048,
) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept`` (id = component_id).

    Vectors are compared only when labels are equal and not null. Each is projected to
    eight dimensions per table; the nearest E8 point is its home cell, and the nearest of
    the 240 neighbouring cells are probed. Two vectors are candidates when one's
    home is the other's home or probe; a pair is linked when its cosine in double
    precision is at least ``threshold``. A pair that meets more than once counts
    in the first of its cells only.

    * vectors that are null, empty, zero, or hold null or non-finite components, and rows
      with a null label, have no links and are their own component.
    * rows with null id have no links, a null component, and are kept.
    * equal vectors of one label are one class, linked with each other; rows that repeat an
      id are separate vectors. Vectors of different lengths never link.
    * an empty table gives an empty result; other columns are not read.

    Keys travel first; vectors follow only into cells that two classes share. A cell of
    more than ``unit_rows`` classes is joined in pairs of chunks, and only counts and
    a spanning forest leave a task, never all pairs.
    """
    lattice = LatticeTables(tables, probes, scale, seed)
    v = F.col("_v")
    base = vectors.select(
        F.col(id_col).cast("bigint").alias("_id"),
        F.col(vector_col).cast("array<double>").alias("_v"),
        F.col(label_col).cast("string").alias("_label"),
    )
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(
        (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0) & F.col("_id").isNotNull() & F.col("_label").isNotNull(),
        F.lit(False),
    )
    base = base.select("_id", "_label", F.when(usable, v).alias("_v"))
    live = base.filter("_v IS NOT NULL")
    # A class is a label and a vector; ``rep`` is its own number, as an id may come with several vectors.
    classes = live.groupBy("_label", "_v").agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("size"))
    classes = write_through(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")

    def cells(batches):
        for batch in batches:
            table = pa.table(batch)
            lengths = np.asarray(table.column("_v").combine_chunks().value_lengths())
            for d in np.unique(lengths):
                part = table.filter(pa.array(lengths == d)).combine_chunks()
                keys = lattice.keys(_units(part.column("_v").combine_chunks()))
                n, per = len(keys), keys[0].size
                home = np.tile(np.arange(per) % (1 + probes) == 0, n)
                at = pa.array(np.repeat(np.arange(n), per))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_label").combine_chunks().take(at),
                        pa.array(keys.ravel()),
                        pa.array(home),
                        part.column("rep").combine_chunks().take(at),
                    ],
                    names=["label", "cell", "home", "rep"],
                )

    keys = classes.mapInArrow(lean_map(cells), "label string, cell bigint, home boolean, rep bigint")
    keys = write_through(keys.select(F.xxhash64("label", "cell").alias("cell"), F.col("cell").alias("key"), "home", "rep"), "cells")
    shared = keys.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("some"))
    shared = shared.filter("n > 1 AND some").select("cell", F.ceil(F.col("n") / unit_rows).alias("parts"))
    shared = write_through(shared, "shared")
    split = (
        keys.join(shared, "cell")
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        .select(
            F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"),
            "key", "home", "rep", "mine",
        )
    )
    split = write_through(split, "split")
    tasks = max(24, int(split.count() // 4096) + 1)
    joined = split.join(classes.select("rep", "size", "_label", "_v"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        out = _compare(table, lattice, threshold)
        a, b, n = (list(x) for x in zip(*out)) if out else ([], [], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    found = joined.withColumn("task", F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(tasks))).groupBy("task").applyInArrow(
        lean_table(compare), "a bigint, b bigint, n bigint"
    )
    # Rows with b are links of the forest; rows without are counts of links.
    found = write_through(found, "found")
    counts = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    labels = write_through(connected_components(found.filter("b IS NOT NULL").select("a", "b")), "components")
    # The smallest id of each component, copied to every salt: a component may hold a third of all classes.
    names = labels.join(classes.select("rep", "low"), F.col("node") == F.col("rep")).groupBy("component").agg(F.min("low").alias("name"))
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    labels = labels.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(32)).cast("int")).join(names, ["component", "salt"])
    labels = labels.select("node", "name")
    named = (
        classes.select("rep", "low", "size", F.col("_label").alias("l"), F.col("_v").alias("w"))
        .join(counts, F.col("rep") == F.col("a"), "left")
        .join(labels, F.col("rep") == F.col("node"), "left")
        .select(
            "l", "w",
            (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("name", "low").alias("component_id"),
        )
    )
    named = write_through(named, "named")
    component = F.coalesce("component_id", "_id")
    return base.join(named, (F.col("_label") == F.col("l")) & (v == F.col("w")), "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


def _compare(table: pa.Table, lattice: LatticeTables, threshold: float) -> list[tuple[int, int | None, int]]:
    """Links of the cells of a task, as forest edges ``(a, b, 0)`` and counts ``(class, None, links)``."""
    rep, key, home = (table.column(c).to_numpy() for c in ("rep", "key", "home"))
    mine, size = table.column("mine").to_numpy(), table.column("size").to_numpy()
    lengths = np.asarray(table.column("_v").combine_chunks().value_lengths())
    label = np.unique(np.array(table.column("_label").to_pylist(), object), return_inverse=True)[1]
    tally: dict[int, int] = {}
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def settle(rows: np.ndarray, unit: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Count the pairs whose first meeting is here, and join them."""
        used, back = np.unique(np.r_[i, j], return_inverse=True)
        keys = lattice.keys(unit[used])
        a, b = keys[back[: len(i)]], keys[back[len(i) :]]
        never = np.iinfo(np.int64).max
        met = np.concatenate(
            [
                np.where((a[:, :, :1] == b).any(axis=2), a[:, :, 0], never),
                np.where((b[:, :, :1] == a).any(axis=2), b[:, :, 0], never),
            ],
            axis=1,
        ).min(axis=1)
        here = met == key[rows[i]]
        i, j = rows[i[here]], rows[j[here]]
        ends = np.r_[i, j]
        linked, back = np.unique(rep[ends], return_inverse=True)
        links = np.bincount(back, weights=np.r_[size[j], size[i]], minlength=len(linked))
        for x, n in zip(linked.tolist(), links.tolist()):
            tally[x] = tally.get(x, 0) + int(n)
        root = np.array([find(x) for x in linked.tolist()], np.int64)
        a, b = root[back[: len(i)]], root[back[len(i) :]]
        for x, y in set(zip(a[a != b].tolist(), b[a != b].tolist())):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)

    vectors = table.column("_v").combine_chunks()
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        units_ = _units(vectors.take(pa.array(at)))
        group = np.lexsort((key[at], table.column("unit").to_numpy()[at]))
        rows_, unit_ids = at[group], table.column("unit").to_numpy()[at][group]
        cuts = np.flatnonzero(np.r_[True, (unit_ids[1:] != unit_ids[:-1]) | (key[rows_][1:] != key[rows_][:-1])])
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows_)]):
            if hi - lo < 2:
                continue
            rows, unit = rows_[lo:hi], units_[group[lo:hi]]
            cross = bool((mine[rows] != mine[rows[0]]).any())
            for first in range(0, len(rows), 1024):
                i, j = np.nonzero(unit[first : first + 1024] @ unit.T >= threshold - 1e-9)
                i += first
                # Each pair once, never two probes; between chunks only pairs across.
                ri, rj = rows[i], rows[j]
                ok = (rep[ri] < rep[rj]) & (home[ri] | home[rj]) & (label[ri] == label[rj])
                if cross:
                    ok &= mine[ri] != mine[rj]
                i, j = i[ok], j[ok]
                for p in range(0, len(i), 50_000):
                    x, y = i[p : p + 50_000], j[p : p + 50_000]
                    exact = (unit[x] * unit[y]).sum(axis=1) >= threshold
                    if exact.any():
                        settle(rows, unit, x[exact], y[exact])
    out: list[tuple[int, int | None, int]] = [(x, None, n) for x, n in tally.items()]
    out += [(find(x), x, 0) for x in list(parent) if find(x) != x]
    return out
