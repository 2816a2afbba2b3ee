"""Operator 11: periodic runs by a grammar.

A run is a stretch of consecutive words with smallest period q and length >= max(``LEAST``, 2 q)
that no neighbouring word extends keeping period q. A word is dropped if any run
contains it after that run's first q words.

1. Word ids of many documents stand in one array. A document whose ``GRAM``-grams are all different has no
   run: in a run, at least LEAST / 2 words in a row equal those q further on.
2. Re-Pair on the word ids of the others, in rounds: a round counts the adjacent pairs of each document and replaces every
   pair that is more frequent than the pairs that it overlaps by a symbol of its own, until no pair is
   found twice. What remains of a document is halved into a balanced tree over its symbols, so every place between
   two words is the boundary of one node of the derivation.
3. Of each distinct symbol, the runs that cross its boundary are computed once, within its expansion. Periods to
   try are the distances from the grams at the boundary to the same grams before them; a period is tried in ascending order, and
   a multiple of a found run's that stays within this run is not tried.
4. A symbol's runs are moved to all places where it is derived. Every run crosses the boundary of the least node that holds it, so
   intervals that a neighbouring word extends are pieces and go; of equal intervals the least period counts.

Runs of all documents of a batch are found side by side in numpy; a batch holds about ``BATCH`` words, or one longer document.

Edge cases: null and empty texts have no words and no runs; runs may overlap (each is listed); a document that is one run throughout
keeps its first q words; very long texts are handled whole, in memory in proportion to their words; repeated rows give equal
rows; an empty table gives an empty result; a null doc_id is a row like others; columns of the
input beside the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import mixed, sliced

LEAST, BATCH = 12, 1 << 18
GRAM = LEAST // 2

_RUNS = "array<struct<start: long, length: long, period: long>>"


def _grams(w: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A hash of the GRAM words from each place on; every place whose gram would pass its document's end has one of its own."""
    n = len(w)
    h = mixed(np.arange(n, dtype=np.uint64), np.full(n, 1, np.uint64))
    if n >= GRAM:
        m = n - GRAM + 1
        whole = doc[:m] == doc[GRAM - 1 :]
        u = w.astype(np.uint64)
        h[:m][whole] = mixed(doc[:m].astype(np.uint64), *(u[i : i + m] for i in range(GRAM)))[whole]
    return h


def repair(w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds; no two documents share a word id. Of the sequence that remains: symbols (below ``first`` words, then rules) and places; of the rules:
    left, right, and a place where each is derived."""
    seq, at = w.astype(np.int64), np.arange(len(w))
    fresh, first = int(w.max(initial=-1)) + 1, int(w.max(initial=-1)) + 1
    live = np.ones(len(seq), bool)  # whether the pair that begins here may be found twice
    rules: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        n = len(seq)
        if n < 2:
            break
        own = doc[at]
        here = np.flatnonzero(live[:-1] & (own[1:] == own[:-1]))
        if not len(here):
            break
        a, b = seq[here], seq[here + 1]
        odd = _odd(seq, own)[here]
        late = (a == b) & odd  # of aaa, one pair
        waits = here[late]
        here, a, b = (x[~late] for x in (here, a, b))
        if not len(here):
            break
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        k = key[order]
        head = np.append(True, k[1:] != k[:-1])
        size = np.diff(np.flatnonzero(head), append=len(k))
        count = np.empty(len(k), np.int64)
        count[order] = np.repeat(size, size)
        # the best of the pairs that overlap: by count, then by hash, then by place
        score = np.zeros(n + 1, np.int64)
        score[here] = count
        tie = np.zeros(n + 1, np.uint64)
        tie[here] = mixed(key)
        exact = np.zeros(n, np.uint64)
        exact[here] = key
        s, t = score[:n], tie[:n]
        ls, lt = np.append(0, s[:-1]), np.append(np.uint64(0), t[:-1])
        rs, rt = score[1 : n + 1], tie[1 : n + 1]
        win = (s >= 2) & ((s > ls) | ((s == ls) & (t > lt))) & ((s > rs) | ((s == rs) & (t >= rt)))
        live = s >= 2
        live[waits] = True
        sel = np.flatnonzero(win)
        if not len(sel):
            break
        _, where, name = np.unique(exact[sel], return_index=True, return_inverse=True)
        rep = sel[where]
        rules.append((seq[rep], seq[rep + 1], at[rep]))
        seq[sel] = fresh + name
        fresh += len(rep)
        gone = np.zeros(n, bool)
        gone[sel + 1] = True
        live[sel] = True
        live[np.maximum(sel - 1, 0)] = True
        keep = ~gone
        # a pair that begins left of a new symbol is new too, also where that symbol's left neighbour went
        seq, at, live = seq[keep], at[keep], live[keep]
        made = seq >= fresh - len(rep)
        live[:-1] |= made[1:]
    if rules:
        left, right, place = (np.concatenate(x) for x in zip(*rules, strict=True))
    else:
        left = right = place = np.empty(0, np.int64)
    return seq, at, left, right, place


def _odd(seq: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a place is an odd one within its stretch of equal symbols."""
    new = np.ones(len(seq), bool)
    new[1:] = (seq[1:] != seq[:-1]) | (doc[1:] != doc[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(seq)), 0))
    return (np.arange(len(seq)) - start) % 2 == 1


def nodes(w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, boundary, end of an occurrence of each distinct node of the derivation, and all (node, shift) where it occurs again."""
    seq, at, left, right, place = repair(w, doc)
    first = int(w.max(initial=-1)) + 1
    size = np.ones(first + len(left), np.int64)
    for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True), first):
        size[r] = size[a] + size[b]
    lo, mid, hi = place, place + size[left], place + size[left] + size[right]
    # all places of each symbol: down from the sequence, the newest rules first
    sym, pos, more_node, more_at = seq[seq >= first], at[seq >= first], [], []
    while len(sym):
        more_node.append(sym - first)
        more_at.append(pos)
        a, b = left[sym - first], right[sym - first]
        sym, pos = np.concatenate([a, b]), np.concatenate([pos, pos + size[a]])
        sym, pos = sym[sym >= first], pos[sym >= first]
    node = np.concatenate(more_node) if more_node else np.empty(0, np.int64)
    shift = (np.concatenate(more_at) if more_at else np.empty(0, np.int64)) - place[node]
    # the tree over what remains of each document: neighbours are joined two by two
    begin, end, own = at, at + size[seq], doc[at] if len(at) else at
    tops = [(lo, mid, hi)]
    while len(begin) > 1:
        new = np.append(True, own[1:] != own[:-1])
        nth = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        joins = np.flatnonzero((nth[:-1] % 2 == 0) & (own[1:] == own[:-1]))
        if not len(joins):
            break
        tops.append((begin[joins], end[joins], end[joins + 1]))
        gone = np.zeros(len(own), bool)
        gone[joins + 1] = True
        end = end.copy()
        end[joins] = end[joins + 1]
        begin, end, own = begin[~gone], end[~gone], own[~gone]
    lo, mid, hi = (np.concatenate(x) for x in zip(*tops, strict=True))
    return lo, mid, hi, node, shift


def _reach(w: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """How many words from a and b on (backwards with step -1) are equal, up to the limit of each; wider steps while all are."""
    out, on, width = np.zeros(len(a), np.int64), np.arange(len(a)), 8
    while len(on):
        k = np.arange(width)
        i = out[on][:, None] + k
        within = i < limit[on][:, None]
        x, y = (np.clip(p[on][:, None] + step * i, 0, len(w) - 1) for p in (a, b))
        same = within & (w[x] == w[y])
        full = same.all(1)
        out[on] += np.where(full, width, np.argmin(same, 1))
        on = on[full]
        width = min(4096, width * 2) if len(on) * width < 1 << 20 else width
    return out


def crossing(w: np.ndarray, grams: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, start, end, period of the runs within [lo, hi) that cross the boundary mid."""
    order = np.argsort(grams, kind="stable")
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.arange(len(grams))
    g = grams[order]
    head = np.maximum.accumulate(np.where(np.append(True, g[1:] != g[:-1]), np.arange(len(g)), 0)) if len(g) else np.empty(0, np.int64)
    tail = np.append(g[1:] == g[:-1], False)
    repeated = np.zeros(len(grams), bool)
    repeated[order] = tail | (head != np.arange(len(g)))
    cand_n, cand_q = [], []
    after_of = tail_count(head, len(g))
    for back in range(GRAM + 1):
        # the run's gram that holds the word after the boundary, or the one before it, and the same gram q words earlier
        j = mid - back
        at = np.flatnonzero((j >= lo) & repeated[np.minimum(np.maximum(j, 0), len(grams) - 1)])
        r = rank[j[at]]
        prior = r - head[r]  # earlier places of the gram stand before it in the order
        if not len(at):
            continue
        n, nth = np.repeat(at, prior), np.arange(prior.sum()) - np.repeat(np.cumsum(prior) - prior, prior)
        p = order[np.repeat(head[r], prior) + nth]
        q = j[n] - p
        fine = (p >= lo[n]) & (2 * q <= hi[n] - lo[n])
        cand_n.append(n[fine])
        cand_q.append(q[fine])
        # the run's words on the right: the gram at the boundary and the same one q words later
        after = after_of[r]
        n, nth = np.repeat(at, after), np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)
        p = order[np.repeat(r + 1, after) + nth]
        q = p - j[n]
        fine = (p + GRAM <= hi[n]) & (2 * q <= hi[n] - lo[n])
        cand_n.append(n[fine])
        cand_q.append(q[fine])
    if not sum(map(len, cand_n)):
        return (np.empty(0, np.int64),) * 4
    n, q = np.divmod(np.unique(np.concatenate(cand_n) * len(w) + np.concatenate(cand_q)), len(w))
    done = []
    turn = 1
    while len(n):
        nth = np.arange(len(n)) - np.maximum.accumulate(np.where(np.append(True, n[1:] != n[:-1]), np.arange(len(n)), 0))
        now = nth < turn
        a, p = n[now], q[now]
        # words equal those p further on: from the boundary's left side of the period outward
        best = None
        for i0 in (mid[a] - p, mid[a] - 1):  # a match that the crossing run must hold: of its left or its right half
            ok = (i0 >= lo[a]) & (i0 + p < hi[a])
            x = np.where(ok, i0, lo[a])
            fwd = _reach(w, x, x + p, np.where(ok, hi[a] - p - x, 0), 1)
            bwd = _reach(w, x - 1, x - 1 + p, np.where(ok & (fwd > 0), x - lo[a], 0), -1)
            s, m = x - bwd, fwd + bwd
            e = s + m + p
            good = ok & (fwd > 0) & (m >= np.maximum(LEAST - p, p)) & (s < mid[a]) & (e > mid[a])
            found = (a[good], s[good], e[good], p[good])
            best = found if best is None else tuple(np.concatenate(v) for v in zip(best, found, strict=True))
        done.append(best)
        n, q = n[~now], q[~now]
        if len(n) and len(best[0]):
            # a multiple of a found run's period that reaches from the boundary no further than this run, on both sides, gives this run
            fn, fs, fe, fp = best
            o = np.argsort(fn, kind="stable")
            fn, fs, fe, fp = fn[o], fs[o], fe[o], fp[o]
            lo_, hi_ = np.searchsorted(fn, n), np.searchsorted(fn, n, "right")
            drop = np.zeros(len(n), bool)
            for k in range(int((hi_ - lo_).max(initial=0))):
                at = np.minimum(lo_ + k, len(fn) - 1)
                drop |= (lo_ + k < hi_) & (q % fp[at] == 0) & (mid[n] - q >= fs[at]) & (mid[n] + q <= fe[at])
            n, q = n[~drop], q[~drop]
        turn = min(64, turn * 2)
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def tail_count(head: np.ndarray, n: int) -> np.ndarray:
    """Of each place in the order, how many of the same gram stand after it."""
    size = np.bincount(head, minlength=n)
    return head + size[head] - 1 - np.arange(n)


def runs(w: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, period of all runs, by place in w; documents' words stand together."""
    none = (np.empty(0, np.int64),) * 3
    grams = _grams(w, doc)
    s = np.sort(grams)
    again = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(again):
        return none
    hit = again[np.minimum(np.searchsorted(again, grams), len(again) - 1)] == grams
    on = np.isin(doc, np.unique(doc[hit]))
    place = np.flatnonzero(on)
    w, doc, grams = w[on], doc[on], grams[on]
    _, w = np.unique(doc * (int(w.max()) + 1) + w, return_inverse=True)
    lo, mid, hi, node, shift = nodes(w, doc)
    n, start, end, period = crossing(w, grams, lo, mid, hi)
    # to all places where a node is derived again; its own first place has shift 0
    by = np.argsort(node, kind="stable")
    count = np.bincount(node, minlength=len(lo))
    begin = np.cumsum(count) - count
    times = count[n]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    moved = shift[by][np.repeat(begin[n], times) + nth]
    again_ = tuple(np.repeat(v, times) + moved for v in (start, end))
    start, end, period = np.concatenate([start, again_[0]]), np.concatenate([end, again_[1]]), np.concatenate([period, np.repeat(period, times)])
    if not len(start):
        return none
    # pieces of longer runs go: those that a neighbouring word extends; of equal intervals the least period stays
    extends = lambda p, q: (np.minimum(p, q) >= 0) & (np.maximum(p, q) < len(w)) & (w[np.clip(p, 0, len(w) - 1)] == w[np.clip(q, 0, len(w) - 1)])  # noqa: E731  no two documents share an id
    whole = ~extends(start - 1, start - 1 + period) & ~extends(end, end - period)
    start, end, period = start[whole], end[whole], period[whole]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))
    start, end, period = start[least], end[least], period[least]
    return place[start], place[end - 1] + 1, period


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query's contract: some documents go on periodically from a word that their id chooses."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _find(change: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids, texts, held, count = b.column(0).to_pylist(), b.column(1), [], 0
            for k, i in enumerate(ids):
                words = (texts[k].as_py() or b"").split()
                held.append((i, change(i, words) if change else words))
                count += len(words)
                if count >= BATCH:
                    yield made(held)
                    held, count = [], 0
            if held:
                yield made(held)

    def made(docs: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        size = np.array([len(x) for _, x in docs])
        w = np.fromiter((number.setdefault(x, len(number)) for _, words in docs for x in words), np.int64, int(size.sum()))
        doc = np.repeat(np.arange(len(docs)), size)
        start, end, period = runs(w, doc)
        first = np.cumsum(size) - size
        of = doc[start]
        edge = np.zeros(len(w) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, end, -1)
        gone = np.cumsum(edge[:-1]) > 0
        rows = [[] for _ in docs]
        for d, s, n, q in zip(of.tolist(), (start - first[of]).tolist(), (end - start).tolist(), period.tolist(), strict=True):
            rows[d].append({"start": s, "length": n, "period": q})
        kept = []
        for k, (_, words) in enumerate(docs):
            if rows[k]:
                words = [x for x, g in zip(words, gone[first[k] : first[k] + size[k]].tolist(), strict=True) if not g]
            kept.append(b" ".join(words))
        cols = [pa.array([i for i, _ in docs], pa.int64()), pa.array(size, pa.int64()), pa.array(rows, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(kept, pa.binary())]
        return pa.record_batch(cols, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def find(documents: DataFrame, change: Callable | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed, the kept words joined by one space, of every row."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = texts.mapInArrow(_find(change), f"doc_id long, n_words long, runs {_RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def digest(found: DataFrame) -> DataFrame:
    """The longest run's figures (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    out = found.withColumn("_best", F.when(F.size("runs") > 0, best))
    length, period = -F.col("_best.less"), F.col("_best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = f"""
WITH codes AS (
  SELECT doc_id, coalesce(text, '') AS text, [4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM documents
), h AS (
  SELECT doc_id, text, xor(4294967295, list_reduce(steps, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h FROM codes
), split AS (
  SELECT doc_id, h, h // 10 AS g, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM h
), placed AS (
  SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN g % len(ws) ELSE len(ws) END AS a FROM split
), shaped AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed
), w AS (
  SELECT doc_id, i, ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS w FROM (SELECT *, unnest(range(0, n)) AS i FROM shaped)
), grams AS (
  SELECT doc_id, i, hash(w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o) AS g, lead(w, 5) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), same AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i FROM grams a JOIN grams b ON b.doc_id = a.doc_id AND b.g = a.g AND b.i > a.i WHERE a.whole AND b.whole
), stretches AS (
  SELECT doc_id, q, min(i) AS s, max(i) + {GRAM} + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, s, e, min(q) AS q FROM stretches WHERE e - s >= greatest({LEAST}, 2 * q) GROUP BY doc_id, s, e
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS text FROM w ANTI JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i GROUP BY w.doc_id
), listed AS (
  SELECT doc_id, count(*) AS n, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
), best AS (
  SELECT doc_id, s, e - s AS length, q FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s, q) = 1
)
SELECT d.doc_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * b.length // b.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(l.lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
