"""Suffix-array dedup: sorted suffix runs, exchanged front-coded, merged by loser trees.

1. Every window of 50 bytes names one anchor inside itself, the 24-byte gram with
   the smallest hash. Equal windows have the same anchor at the same place, so only
   suffixes that start at anchors need sorting. A sieve drops anchors whose gram
   occurs in one document only.
2. A block of documents sorts its anchor suffixes (what lies right of the anchor,
   then what lies left of it), merges equal ones, and sends one front-coded run per
   bucket of grams: the length of the prefix shared with the predecessor, and the rest.
3. A bucket merges the runs with a loser tree whose players carry the length of
   the prefix they share with the last winner. Two players are compared by these
   lengths; bytes are read only beyond an equal length.
4. The merged order and its common prefixes give, for each suffix, the smallest
   document that has it, and for suffixes that share a gram the windows they share.
   Blocks get these back and cut the covered bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from framelark.llm.lean import lean_cogroup, lean_group

from framelark.llm.packed import BASE_INV, mix, pieces, powers, prefix_hash, ragged, text_bytes
from framelark.llm.sieve import (
    block_count,
    codes_of,
    distinct_keys,
    judge,
    pack_ints,
    run_rows,
    RUNS,
    sorted_keys,
    squeeze,
    unpack_ints,
    unsqueeze,
)

CHUNK = 1 << 17
LOW = np.uint64((1 << 20) - 1)
NO_ID = np.iinfo(np.int64).max


def anchors(buf: np.ndarray, off: np.ndarray, usable: np.ndarray, window: int, gram: int):
    """``(position, row, hash, lo, hi)``: the anchor serves the windows that start ``lo..hi`` bytes before it."""
    found: list[tuple[np.ndarray, ...]] = []
    spread = window - gram + 1
    for first, last in pieces(off, CHUNK):
        begin, stop = int(off[first]), int(off[last])
        for at in range(begin, max(begin + 1, stop - window + 1), CHUNK):
            upto = min(stop, at + CHUNK + window - 1) if stop - begin > CHUNK else stop
            chunk = buf[at:upto]
            n = len(chunk)
            if n < window:
                break
            prefix = prefix_hash(chunk)
            h = mix((prefix[gram:] - prefix[:-gram]) * powers(n + 1, BASE_INV)[: n - gram + 1])
            low = (h & ~LOW) | np.arange(n - gram + 1, dtype=np.uint64)
            width = 1
            while width * 2 <= spread:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if width < spread:
                low = np.minimum(low[: -(spread - width)], low[spread - width :])
            ends = np.minimum(off[first + 1 : last + 1], upto) - at
            lengths = np.diff(np.r_[0, ends])
            room = np.repeat(np.where(usable[first:last], ends, -1), lengths)[: len(low)]
            starts = np.flatnonzero(np.arange(window, window + len(low)) <= room)
            if len(starts):
                pos = (low[starts] & LOW).astype(np.int64)
                head = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (starts[1:] != starts[:-1] + 1)])
                tail = np.r_[head[1:], len(starts)] - 1
                p = pos[head]
                row = np.searchsorted(off, p + at, "right") - 1
                found.append((p + at, row, h[p], p - starts[tail], p - starts[head]))
            if upto == stop:
                break
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _block(table: pa.Table):
    """The rows of a block in an order that does not depend on how they arrived."""
    ids = table.column("_id").combine_chunks()
    known = ~np.asarray(ids.is_null())
    values = np.asarray(ids.fill_null(NO_ID)).astype(np.int64)
    order = np.lexsort((np.asarray(table.column("_mark").combine_chunks()), values, ~known))
    table = table.take(pa.array(order))
    buf, off = text_bytes(table.column("_text"))
    return table, buf, off, values[order], known[order]


def _keyed(buf, off, ids, known, window, gram, buckets):
    pos, row, h, lo, hi = anchors(buf, off, known, window, gram)
    keys = sorted_keys(mix(h ^ np.uint64(0x5851F42D4C957F2D)), buckets)
    distinct, several, index = distinct_keys(keys, ids[row])
    return pos, row, lo, hi, distinct, several, index


def _suffixes(buf, pos, lo, hi, window: int, gram: int) -> np.ndarray:
    """One padded row per anchor: right side, its length, left side backwards, its length + 1."""
    left = window - gram
    out = np.zeros((len(pos), window + left + 2), np.uint8)
    for j in range(window):
        inside = j < window - lo
        out[inside, j] = buf[pos[inside] + j]
    out[:, window] = window - lo
    for j in range(left):
        inside = j < hi
        out[inside, window + 1 + j] = buf[pos[inside] - 1 - j]
    out[:, -1] = hi + 1
    return out


def _front_code(rows: np.ndarray) -> bytes:
    n, width = rows.shape
    differ = rows[1:] != rows[:-1]
    lcp = np.zeros(n, np.uint8)
    lcp[1:] = np.argmax(differ, axis=1)
    rest = rows.ravel()[ragged(np.arange(n) * width + lcp, width - lcp.astype(np.int64))]
    return squeeze(n.to_bytes(8, "little") + lcp.tobytes() + rest.tobytes())


def _front_decode(data: bytes, width: int) -> tuple[list[bytes], list[int]]:
    raw = unsqueeze(data)
    n = int.from_bytes(raw[:8], "little")
    lcp = list(raw[8 : 8 + n])
    out, at, last = [], 8 + n, b""
    for shared in lcp:
        upto = at + width - shared
        last = last[:shared] + raw[at:upto]
        at = upto
        out.append(last)
    return out, lcp


def merge_runs(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[list[int], list[int]]:
    """Merge sorted runs of ``width``-byte strings; returns ``(run << 32 | index, common prefix)`` in order.

    A player of the loser tree keeps the length of the prefix it shares with the
    string that won last. The longer length is the smaller string; only at equal
    lengths are bytes compared, from that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    done = -1
    lcp = [0 if r < len(runs) and runs[r][0] else done for r in range(k)]
    text = [runs[r][0][0] if lcp[r] == 0 else b"" for r in range(k)]
    place = [0] * k
    size = [len(runs[r][0]) if r < len(runs) else 0 for r in range(k)]
    tree = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length is then relative to the winner."""
        x, y = lcp[a], lcp[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x == done or x == width:
            return a, b
        p, q = int.from_bytes(text[a][x:], "big"), int.from_bytes(text[b][x:], "big")
        shared = width - ((p ^ q).bit_length() + 7 >> 3)
        if p <= q:
            lcp[b] = shared
            return a, b
        lcp[a] = shared
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, lost = play(build(2 * node), build(2 * node + 1))
        tree[node] = lost
        return won

    won = build(1) if k > 1 else 0
    codes: list[int] = []
    shares: list[int] = []
    from_bytes = int.from_bytes
    while lcp[won] != done:
        i = place[won]
        codes.append(won << 32 | i)
        shares.append(lcp[won])
        i += 1
        place[won] = i
        if i < size[won]:
            text[won] = runs[won][0][i]
            x = lcp[won] = runs[won][1][i]
        else:
            x = lcp[won] = done
        node = won + k >> 1
        while node:
            other = tree[node]
            y = lcp[other]
            if y > x:
                tree[node], won, x = won, other, y
            elif y == x and x != done and x != width:
                p, q = from_bytes(text[won][x:], "big"), from_bytes(text[other][x:], "big")
                shared = width - ((p ^ q).bit_length() + 7 >> 3)
                if p <= q:
                    lcp[other] = shared
                else:
                    lcp[won] = shared
                    tree[node], won = won, other
            node >>= 1
    return codes, shares


def _shared_windows(rows: np.ndarray, lcp: np.ndarray, low: np.ndarray, window: int, gram: int):
    """``(class, o, document)`` where a window of a class also stands in an earlier document of another class.

    ``rows`` are distinct suffixes in order, ``lcp`` their common prefix with the
    predecessor, ``low`` their smallest document. The window that starts ``o`` bytes
    before the anchor reaches ``window - o`` bytes right, so a neighbour in the order
    must share that much.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.minimum(lcp, window)
    best = np.maximum(near, np.r_[near[1:], 0])
    right, left = rows[:, window].astype(np.int64), rows[:, -1].astype(np.int64) - 1
    first = np.maximum(window - right, window - best)
    some = np.flatnonzero((best >= gram) & (first <= left))
    if not len(some):
        return nothing
    count = left[some] - first[some] + 1
    cls = np.repeat(some, count)
    o = ragged(first[some], count)
    wide = rows[some]
    line = np.repeat(np.arange(len(some)), count)

    def running(part: np.ndarray, salt: int) -> np.ndarray:
        out = np.zeros((len(part), part.shape[1] + 1), np.uint64)
        terms = mix(part.astype(np.uint64) + (np.arange(part.shape[1], dtype=np.uint64) << np.uint64(9)) + np.uint64(salt << 20))
        np.cumsum(terms, axis=1, out=out[:, 1:])
        return out

    # Both sides are hashed outward from the anchor, so a sum over positions names a window.
    key = mix(running(wide[:, :window], 1)[line, window - o] + running(wide[:, window + 1 : -1], 2)[line, o] + o.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = np.r_[False, key[order][1:] == key[order][:-1]]

    def content(sel: np.ndarray) -> np.ndarray:
        c, back = line[sel], o[sel]
        j = np.arange(window)[None, :] - back[:, None]
        return wide[c[:, None], np.where(j >= 0, j, window - j)]

    for at in range(0, len(order), 100_000):
        chunk = np.flatnonzero(same[at : at + 100_000]) + at
        if len(chunk) and not np.array_equal(content(order[chunk]), content(order[chunk - 1])):
            # Two windows with one hash: order by the bytes themselves.
            full = np.ascontiguousarray(content(np.arange(len(key)))).view(f"V{window}").ravel()
            _, group = np.unique(full, return_inverse=True)
            order = np.argsort(group, kind="stable")
            same = np.r_[False, group[order][1:] == group[order][:-1]]
            break
    head = np.flatnonzero(~same)
    least = np.minimum.reduceat(low[cls[order]], head)[np.cumsum(~same) - 1]
    hit = least < low[cls[order]]
    return cls[order][hit], o[order][hit], least[hit]


def join_parts(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def split_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def rows_table(columns: dict[str, list]) -> pa.Table:
    return pa.table({k: pa.array(v, pa.binary() if k == "data" else pa.int64()) for k, v in columns.items()})


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    upto = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=upto[1:])
    return (upto[off[1:]] - upto[off[:-1]]).astype(np.int64)


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    window: int = 50,
    gram: int = 24,
    block_bytes: int = 8 << 20,
    as_text: bool = False,
) -> DataFrame:
    """Remove each byte covered by a ``window``-byte string that also starts in a document with a smaller id.

    Returns per row: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs), ``kept_sha256``, ``kept`` (the remaining bytes) and, with ``carry``,
    ``carried`` (a struct of those columns). With ``as_text`` the remaining bytes are a
    string, without the characters that a cut has split.

    * null text counts as empty; texts shorter than ``window`` keep everything.
    * matches never cross documents; overlaps count; strings are judged on the input.
    * a row with null id neither removes nor loses anything.
    * rows with one id are one document: they remove nothing from each other.
    * an empty table gives an empty result; columns may have any names.

    A document travels to its block once (all three uses share that exchange). No
    document, and no group of equal passages, is ever held in one place: a passage
    reaches its bucket once per block. Blocks hold about ``block_bytes`` of text, and
    there are as many buckets as blocks.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blocks = block_count(docs, text, block_bytes)
    buckets = max(8, blocks)
    width = 2 * window - gram + 2
    mark = F.xxhash64(text, F.octet_length(text))
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("struct<none:int>")
    base = docs.select(
        F.col(id_col).cast("bigint").alias("_id"), text.alias("_text"), mark.alias("_mark"), carried.alias("_carry")
    ).withColumn("_block", F.pmod(F.xxhash64("_id", "_mark"), F.lit(blocks)))
    carry_type = base.schema["_carry"].dataType.simpleString()

    def grams(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, buf, off, ids, known = _block(table)
        *_, distinct, several, _ = _keyed(buf, off, ids, known, window, gram, buckets)
        return run_rows(key[0].as_py(), distinct, several, buckets)

    def sort_runs(key: tuple[pa.Scalar, ...], table: pa.Table, bits: pa.Table) -> pa.Table:
        """Rows for the buckets (front-coded runs) and one row for the block itself (its places)."""
        block = key[0].as_py()
        out = {"to": [], "bucket": [], "block": [], "data": []}
        if table.num_rows and bits.num_rows:
            _, buf, off, ids, known = _block(table)
            pos, row, lo, hi, distinct, _, index = _keyed(buf, off, ids, known, window, gram, buckets)
            live = np.flatnonzero(codes_of(distinct, buckets, bits)[index])
            pos, row, lo, hi = pos[live], row[live], lo[live], hi[live]
            home = (distinct[index[live]] >> np.uint64(32)).astype(np.int64)
            del index, distinct
            for b in np.unique(home):
                mine = np.flatnonzero(home == b)
                rows = _suffixes(buf, pos[mine], lo[mine], hi[mine], window, gram)
                order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
                rows, mine = rows[order], mine[order]
                new = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]
                head = np.flatnonzero(new)
                low = np.minimum.reduceat(ids[row[mine]], head)
                run, lows = _front_code(rows[head]), pack_ints(low)
                out["bucket"].append(int(b))
                out["data"].append(len(run).to_bytes(8, "little") + run + lows)
                place = [pos[mine], lo[mine].astype(np.uint8), hi[mine].astype(np.uint8), new]
                out["bucket"].append(-1 - int(b))
                out["data"].append(join_parts([pack_ints(x) for x in place]))
            out["to"] = [b if b >= 0 else -1 - block for b in out["bucket"]]
            out["block"] = [block] * len(out["bucket"])
        return rows_table(out)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:  # places on their way to their own block
            return table.select(["bucket", "block", "data"])
        names, data = table.column("block").to_pylist(), table.column("data").to_pylist()
        runs, lows = [], []
        for x in data:
            n = int.from_bytes(x[:8], "little")
            runs.append(_front_decode(x[8 : 8 + n], width))
            lows.append(unpack_ints(x[8 + n :], np.int64))
        del data
        codes, shares = merge_runs(runs, width)
        codes, shares = np.array(codes, np.int64), np.array(shares, np.int64)
        base_of = np.r_[0, np.cumsum([len(x) for x in lows])]
        entry = base_of[codes >> 32] + (codes & 0xFFFFFFFF)
        low = np.concatenate(lows)
        head = np.flatnonzero(shares < width)
        of_class = np.cumsum(shares < width) - 1
        least = np.minimum.reduceat(low[entry], head)
        first = codes[head]
        rows = np.frombuffer(b"".join(runs[c >> 32][0][c & 0xFFFFFFFF] for c in first.tolist()), np.uint8).reshape(-1, width)
        del runs
        cls, o, doc = _shared_windows(rows, shares[head], least, window, gram)
        class_of = np.empty(len(low), np.int64)
        class_of[entry] = of_class
        by = np.argsort(cls, kind="stable")
        cls, o, doc = cls[by], o[by], doc[by]
        begin, end = np.searchsorted(cls, np.arange(len(head))), np.searchsorted(cls, np.arange(len(head)), "right")
        out = {"bucket": [], "block": [], "data": []}
        for r, name in enumerate(names):
            mine = class_of[base_of[r] : base_of[r + 1]]
            own = low[base_of[r] : base_of[r + 1]]
            better = np.flatnonzero(least[mine] < own)
            count = (end - begin)[mine]
            if not len(better) and not count.any():
                continue
            extra = ragged(begin[mine], count)
            parts = [better, least[mine][better], np.repeat(np.arange(len(mine)), count), o[extra], doc[extra]]
            out["bucket"].append(bucket)
            out["block"].append(name)
            out["data"].append(join_parts([pack_ints(np.ascontiguousarray(x, np.int64)) for x in parts]))
        return rows_table(out)

    def cut(key: tuple[pa.Scalar, ...], table: pa.Table, notes: pa.Table) -> pa.Table:
        table, buf, off, ids, _ = _block(table)
        change = np.zeros(len(buf) + 1, np.int32)
        noted = dict(zip(notes.column("bucket").to_pylist(), notes.column("data").to_pylist()))

        for b, data in noted.items():
            if b >= 0:
                continue
            places = split_parts(data)
            pos, new = unpack_ints(places[0], np.int64), unpack_ints(places[3], bool)
            lo, hi = unpack_ints(places[1], np.uint8).astype(np.int64), unpack_ints(places[2], np.uint8).astype(np.int64)
            row = np.searchsorted(off, pos, "right") - 1
            item, head = np.cumsum(new) - 1, np.flatnonzero(new)
            least = np.minimum.reduceat(ids[row], head)
            answer = noted.get(-1 - b)
            if answer is not None:
                better, low, who, o, doc = (unpack_ints(x, np.int64) for x in split_parts(answer))
                least[better] = low
                # Windows that an earlier document of another class holds.
                begin, end = np.searchsorted(who, item), np.searchsorted(who, item, "right")
                at = ragged(begin, end - begin)
                of = np.repeat(np.arange(len(item)), end - begin)
                gone = doc[at] < ids[row[of]]
                start = pos[of[gone]] - o[at[gone]]
                np.add.at(change, start, 1)
                np.add.at(change, start + window, -1)
            gone = least[item] < ids[row]
            np.add.at(change, pos[gone] - hi[gone], 1)
            np.add.at(change, pos[gone] - lo[gone] + window, -1)
        np.cumsum(change, out=change)
        covered = change[:-1] > 0
        del change
        removed = _sums(covered, off)
        edge = covered.copy()
        edge[1:] &= ~covered[:-1]
        inner = off[:-1][off[:-1] < len(buf)]
        edge[inner] = covered[inner]
        spans = _sums(edge, off)
        del edge
        kept = buf[~covered]
        del covered
        ends = np.r_[0, np.cumsum(np.diff(off) - removed)]
        view = memoryview(kept)
        digest = [hashlib.sha256(view[ends[i] : ends[i + 1]]).hexdigest() for i in range(len(ids))]
        if as_text:
            # Whole texts stay as they are; cut ones lose the characters that a cut has split.
            parts = [view[ends[i] : ends[i + 1]] for i in range(len(ids))]
            parts = [bytes(p).decode("utf-8", "ignore").encode() if r else p for p, r in zip(parts, removed.tolist())]
            size = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
            body = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(size), pa.py_buffer(b"".join(parts))])
            body = body.cast(pa.string())
            del parts
        else:
            body = pa.Array.from_buffers(
                pa.large_binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)]
            ).cast(pa.binary())
        return pa.table(
            {
                "_id": table.column("_id"),
                "n_bytes": np.diff(off),
                "n_removed": removed.astype(np.int64),
                "n_spans": spans.astype(np.int64),
                "kept_sha256": pa.array(digest, pa.string()),
                "kept": body,
                "carried": table.column("_carry"),
            }
        )

    at_home = base.groupBy("_block")
    runs = at_home.applyInArrow(lean_group(grams), RUNS)
    bits = judge(runs)
    sorted_runs = at_home.cogroup(bits.groupBy("block")).applyInArrow(lean_cogroup(sort_runs), "to bigint, " + RUNS)
    # Runs go to their bucket, places back to their block: one exchange, so blocks are sorted once.
    notes = sorted_runs.groupBy("to").applyInArrow(lean_group(merge), RUNS)
    done = at_home.cogroup(notes.groupBy("block")).applyInArrow(
        lean_cogroup(cut),
        "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        f"kept {'string' if as_text else 'binary'}, carried {carry_type}",
    )
    columns = [F.col("_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    return done.select(*columns, *(["carried"] if carry else []))
