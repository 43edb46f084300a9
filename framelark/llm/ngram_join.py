"""N-gram Jaccard join: prefix filter for candidates, prefix-tree join within candidate groups.

1. Blocks of documents hash their word n-grams; a sieve marks the n-grams that two
   documents hold. A document whose marked n-grams are fewer than the threshold asks
   for can be linked with nothing and goes no further.
2. Equal sets are one class. Classes that share an n-gram of their prefixes are
   candidates; connected candidate groups are what a task joins.
3. A task stores the sets, ordered from rare to frequent, in a radix trie. A set
   walks the trie once: the overlap with a shared prefix is counted once for all sets below
   it, and a subtree is left when the overlap so far plus the shorter of the two
   remaining lengths cannot reach the threshold, or when all of it is linked already.
4. The links found, a spanning forest at most, become components.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framelark.functions.storage import write_through
from framelark.llm.graph import connected_components
from framelark.llm.lean import lean_cogroup, lean_group, lean_table
from framelark.llm.packed import mix, pieces, prefix_hash, ragged, range_hash, text_bytes
from framelark.llm.sieve import RUNS, block_count, codes_of, distinct_keys, judge, run_rows, sorted_keys

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: the distinct, sorted n-gram hashes of each text."""
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, last in pieces(off, 1 << 20):
        base = off[first]
        chunk = _LOWER[buf[base : off[last]]]
        inside = np.r_[False, ~_SPACE[chunk], False]
        # A word ends at the end of its document too.
        edges = off[first : last + 1] - base
        n = len(chunk)
        head = inside[1:-1] & ~inside[:-2]
        tail = inside[1:-1] & ~inside[2:]
        within = edges[edges < n]
        head[within] = inside[1:-1][within]
        ends = edges[1:][edges[1:] > 0] - 1
        tail[ends] = inside[1:-1][ends]
        start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        word = range_hash(prefix_hash(chunk), start, end)
        doc = np.searchsorted(edges, start, "right") - 1
        rows = last - first
        per = np.bincount(doc, minlength=rows)
        # n-grams of n words; a shorter text is one gram of all its words.
        size = np.where(per >= words, words, per)
        begin = np.r_[0, np.cumsum(per)[:-1]]
        grams_of = np.where(per >= words, per - words + 1, (per > 0).astype(np.int64))
        at = ragged(begin, grams_of)
        owner = np.repeat(np.arange(rows), grams_of)
        length = size[owner]
        h = length.astype(np.uint64)
        for j in range(words):
            more = length > j
            h[more] = mix(h[more] * np.uint64(0x9E3779B97F4A7C15) + word[at[more] + j])
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        parts.append(h[new])
        counts.append(np.bincount(owner[new], minlength=rows))
    return np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(counts))].astype(np.int64)


class SetTrie:
    """A radix trie of ordered sets that links each new set to those it reaches the threshold with."""

    def __init__(self, upper: int, lower: int):
        self.upper, self.lower = upper, lower  # linked when lower * overlap >= upper * union
        self.parent: list[int] = []
        self.size: list[int] = []
        self.segment: list[list[int]] = [[]]
        self.child: list[dict[int, int]] = [{}]
        self.here: list[list[int]] = [[]]
        self.rest = [0]  # most grams below a node
        self.least, self.most = [1 << 60], [0]  # set sizes below it
        self.one: list[int] = [-1]  # a set below it
        self.whole: list[bool] = [True]  # all sets below it are linked already

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def _settled(self, node: int) -> bool:
        """Whether all sets below a node have become one group."""
        if self.whole[node]:
            return True
        root = self.find(self.one[node])
        for x in self.here[node]:
            if self.find(x) != root:
                return False
        for c in self.child[node].values():
            if not self.whole[c] or self.find(self.one[c]) != root:
                return False
        self.whole[node] = True
        return True

    def add(self, grams: list[int], size: int) -> int:
        """``size`` counts all grams of the set, ``grams`` (ascending) those another set may share."""
        me = len(self.parent)
        self.parent.append(me)
        self.size.append(size)
        self._probe(me, grams, size)
        self._insert(me, grams, size)
        return me

    def _probe(self, me: int, grams: list[int], size: int) -> None:
        mine, total = set(grams), len(grams)
        up, low = self.upper, self.lower
        both = up + low
        stack = [(0, 0)]
        while stack:
            node, overlap = stack.pop()
            one = self.one[node]
            if one < 0:
                continue
            if self._settled(node) and self.find(one) == self.find(me):
                continue
            least = self.least[node]
            if low * size < up * least or low * self.most[node] < up * size:
                continue
            need = -(-up * (size + least) // both)
            seg = self.segment[node]
            below, left, dead = self.rest[node], len(seg), False
            for at in range(0, left, 32):
                part = seg[at : at + 32]
                overlap += len(mine.intersection(part))
                if overlap + min(total - bisect_right(grams, part[-1]), left - at - len(part) + below) < need:
                    dead = True
                    break
            if dead:
                continue
            for x in self.here[node]:
                if both * overlap >= up * (size + self.size[x]):
                    a, b = self.find(me), self.find(x)
                    if a != b:
                        self.parent[max(a, b)] = min(a, b)
            kids = self.child[node]
            if kids:
                stack.extend((c, overlap) for g, c in kids.items() if g not in mine)
                stack.extend((c, overlap) for g, c in kids.items() if g in mine)

    def _node(self, segment, child, here, rest, least, most, one, whole) -> int:
        for store, value in zip(
            (self.segment, self.child, self.here, self.rest, self.least, self.most, self.one, self.whole),
            (segment, child, here, rest, least, most, one, whole),
        ):
            store.append(value)
        return len(self.segment) - 1

    def _note(self, node: int, me: int, rest: int, size: int) -> None:
        self.rest[node] = max(self.rest[node], rest)
        self.least[node] = min(self.least[node], size)
        self.most[node] = max(self.most[node], size)
        if self.one[node] < 0:
            self.one[node] = me
        elif self.whole[node] and self.find(self.one[node]) != self.find(me):
            self.whole[node] = False

    def _insert(self, me: int, grams: list[int], size: int) -> None:
        node, at = 0, 0
        self._note(0, me, len(grams), size)
        while at < len(grams):
            nxt = self.child[node].get(grams[at])
            if nxt is None:
                new = self._node(grams[at:], {}, [me], 0, size, size, me, True)
                self.child[node][grams[at]] = new
                return
            seg = self.segment[nxt]
            k, most = 0, min(len(seg), len(grams) - at)
            while k < most and seg[k] == grams[at + k]:
                k += 1
            if k < len(seg):  # split: the upper part keeps the number, the lower part moves
                lower = self._node(
                    seg[k:], self.child[nxt], self.here[nxt], self.rest[nxt], self.least[nxt], self.most[nxt],
                    self.one[nxt], self.whole[nxt],
                )
                self.segment[nxt] = seg[:k]
                self.child[nxt], self.here[nxt] = {seg[k]: lower}, []
                self.rest[nxt] += len(seg) - k
            at += k
            node = nxt
            self._note(node, me, len(grams) - at, size)
        self.here[node].append(me)


def trie_links(ids: list[int], sizes: list[int], sets: list[np.ndarray], upper: int, lower: int):
    """``(smallest id of its group, id)`` for every set that is linked with another of the list."""
    every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(inverse, minlength=len(every))
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(every))
    lists = np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])
    trie = SetTrie(upper, lower)
    order = sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i]))
    for i in order:
        trie.add(np.sort(lists[i]).tolist(), sizes[i])
    least: dict[int, int] = {}
    for at, i in enumerate(order):
        root = trie.find(at)
        least[root] = min(least.get(root, ids[i]), ids[i])
    found = [(least[trie.find(at)], ids[i]) for at, i in enumerate(order)]
    return [(a, b) for a, b in found if a != b]


def ngram_jaccard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    threshold: tuple[int, int] = (90, 100),
    block_bytes: int = 8 << 20,
    group_bytes: int = 32 << 20,
) -> DataFrame:
    """One row per input row: id, ``n_shingles`` (set size) and ``component_id``.

    A set holds the distinct ``words``-word shingles of the text, A-Z lower-cased, words
    being runs without white space; a shorter text is one shingle of all its words.
    Two rows are linked when ``threshold[1] * overlap >= threshold[0] * union``;
    ``component_id`` is the smallest id reachable by links, itself included.

    * null, empty or blank text has no shingles and is linked with nothing.
    * rows with null id are counted but linked with nothing; their component is null.
    * rows that repeat an id count as separate texts of one document.
    * an empty table gives an empty result; other columns are not read.

    Shingles are compared by 64-bit hashes, whole sets by 128 bits. Candidate groups
    of over ``group_bytes`` are joined per prefix shingle instead, and a shingle with
    more than that per pair of chunks, so no task holds more; the links are the same.
    """
    upper, lower = threshold
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blocks = block_count(docs, text, block_bytes)
    buckets = max(8, blocks)
    base = docs.select(F.col(id_col).cast("bigint").alias("_id"), text.alias("_text"))
    base = base.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)))
    at_home = base.groupBy("_block")

    def keyed(table: pa.Table):
        buf, off = text_bytes(table.column("_text"))
        grams, bounds = shingle_sets(buf, off, words)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        keys = sorted_keys(grams, buckets)
        return grams, bounds, owner, *distinct_keys(keys, owner)

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        *_, distinct, several, _ = keyed(table)
        return run_rows(key[0].as_py(), distinct, several, buckets)

    def sift(key: tuple[pa.Scalar, ...], table: pa.Table, bits: pa.Table) -> pa.Table:
        ids = table.column("_id").combine_chunks()
        if not table.num_rows:
            grams, bounds, owner, code = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        else:
            grams, bounds, owner, distinct, _, index = keyed(table)
            code = codes_of(distinct, buckets, bits)[index]
        shared = code > 0
        size = np.diff(bounds)
        upto = np.r_[0, np.cumsum(shared)]
        marked = upto[bounds[1:]] - upto[bounds[:-1]]
        live = (size > 0) & (lower * marked >= upper * size) & ~np.asarray(ids.is_null())

        def total(salt: int) -> np.ndarray:
            sums = np.r_[np.uint64(0), np.cumsum(mix(grams ^ np.uint64(salt)))]
            return (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)

        sets = [
            grams[bounds[i] : bounds[i + 1]][shared[bounds[i] : bounds[i + 1]]].tobytes() if live[i] else None
            for i in range(len(size))
        ]
        # The global order: by code, then by hash. Unmarked grams stand first, so a prefix has fewer marked ones.
        length = np.where(live, np.minimum(marked, size - -(-upper * size // lower) + 1 - (size - marked)), 0)
        marks = np.flatnonzero(shared)
        marks = marks[np.lexsort((grams[marks], code[marks], owner[marks]))]
        where = marks[ragged(upto[bounds[:-1]], length)]
        prefix = pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(grams[where].view(np.int64))
        )
        return pa.table(
            {
                "_id": ids,
                "n_shingles": size.astype(np.int64),
                "prefix": prefix,
                "h1": pa.array(total(0x1234567), mask=~live),
                "h2": pa.array(total(0x7654321), mask=~live),
                "grams": pa.array(sets, pa.binary()),
            }
        )

    bits = judge(at_home.applyInArrow(lean_group(send), RUNS))
    rows = at_home.cogroup(bits.groupBy("block")).applyInArrow(
        lean_cogroup(sift), "_id bigint, n_shingles bigint, prefix array<bigint>, h1 bigint, h2 bigint, grams binary"
    )
    rows = write_through(rows, "shingles")
    live = rows.filter("h1 IS NOT NULL")
    classes = write_through(live.groupBy("h1", "h2", "n_shingles").agg(F.min("_id").alias("rep")), "classes")
    first = classes.select(F.col("rep").alias("_first")).distinct()
    sets = live.select(F.col("_id").alias("rep"), F.col("n_shingles").alias("n"), "prefix", "grams")
    links = _links(sets, first, upper, lower, group_bytes)
    # Stored first: a task then runs one Python worker, not the join and the forest at once.
    labels = connected_components(write_through(links, "links"))
    named = write_through(
        classes.join(labels, F.col("rep") == F.col("node"), "left").select(
            F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.coalesce("component", "rep").alias("component")
        ),
        "named",
    )
    return rows.join(named, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left").select(
        F.col("_id").alias(id_col), "n_shingles", F.coalesce("component", "_id").alias("component_id")
    )


def _links(sets: DataFrame, first: DataFrame, upper: int, lower: int, group_bytes: int) -> DataFrame:
    """Links ``(a, b)`` that connect the ``sets`` of the ids in ``first`` as the threshold does.

    Groups are formed from ids and prefixes; the sets themselves move once, to their unit.
    """
    slim = sets.select("rep", "n", "prefix").join(first, F.col("rep") == F.col("_first"), "left_semi")
    postings = write_through(slim.select("rep", "n", F.explode("prefix").alias("gram")).distinct(), "postings")
    groups = write_through(
        postings.groupBy("gram").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high"), "grams"
    )
    near = postings.join(groups.select("gram", "low"), "gram")
    candidate = connected_components(near.select(F.col("low").alias("a"), F.col("rep").alias("b")))
    weight = F.sum(F.col("n") * 8 + 64)
    members = postings.select("rep", "n").distinct()
    placed = write_through(members.join(candidate, F.col("rep") == F.col("node")).select("rep", "n", "component"), "placed")
    sizes = write_through(placed.groupBy("component").agg(weight.alias("bytes")), "weights")
    total = sizes.agg(F.sum("bytes"), F.max("bytes")).first()
    tasks = max(12, int((total[0] or 0) // (group_bytes // 4)) + 1)
    by_size = placed.join(sizes, "component")
    units = by_size.filter(F.col("bytes") <= group_bytes).select(F.xxhash64("component").alias("unit"), "rep")
    if (total[1] or 0) > group_bytes:
        # Large candidate groups: one unit per shared prefix gram, cut into pairs of chunks if that is large too.
        wide = write_through(by_size.filter(F.col("bytes") > group_bytes).select(F.col("rep").alias("_wide")), "wide")
        shared = near.join(wide, F.col("rep") == F.col("_wide"), "left_semi")
        parts = write_through(
            shared.groupBy("gram").agg(weight.alias("w")).select("gram", F.ceil(F.col("w") * 2 / group_bytes).alias("parts")),
            "parts",
        )
        split = (
            shared.join(parts, "gram")
            .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("parts")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        )
        unit = F.xxhash64("gram", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit")
        units = units.union(split.select(unit, "rep"))
    units = write_through(units.select("unit", F.col("rep").alias("_member")), "units")
    units = sets.select("rep", "n", "grams").join(units, F.col("rep") == F.col("_member")).select("unit", "rep", "n", "grams")

    def join(table: pa.Table) -> pa.Table:
        by: dict[int, list[int]] = {}
        for i, unit in enumerate(table.column("unit").to_pylist()):
            by.setdefault(unit, []).append(i)
        reps_, sizes_ = table.column("rep").to_pylist(), table.column("n").to_pylist()
        raw = table.column("grams").to_pylist()
        a, b = [], []
        for rows in by.values():
            if len(rows) < 2:
                continue
            found = trie_links(
                [reps_[i] for i in rows], [sizes_[i] for i in rows], [np.frombuffer(raw[i], np.uint64) for i in rows],
                upper, lower,
            )
            a.extend(x for x, _ in found)
            b.extend(x for _, x in found)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return (
        units.withColumn("task", F.pmod(F.xxhash64("unit", F.lit(7)), F.lit(tasks)))
        .groupBy("task")
        .applyInArrow(lean_table(join), "a bigint, b bigint")
    )
