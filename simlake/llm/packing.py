"""Order-preserving packing of documents into windows of at most `window` tokens, by dynamic programming.

Documents keep their order by doc_id. The stream of a shard (shard_span consecutive ids) is cut into windows; a cut may fall at the end
of a document, at no cost, or at the end of a sentence, at `sentence_cost`; a sentence longer than a window may also be cut inside, after
each `window` tokens and before white space where it has any there, at `inside_cost`. The cuts minimise the sum of padding (tokens that windows fall short) and
of those costs. With b(j) the tokens before cut j, f(j) = cost(j) + window - b(j) + min(f(i) + b(i)) over the i with b(j) - b(i)
<= window; these i move to the right with j, so a monotone queue holds the minimum and the time is linear in the cuts.

Tokens are those of a byte-level BPE vocabulary, counted from pre-token lengths (see token_counts), so no text is encoded twice.
Only the cuts' places are shuffled, never texts: a window lists pieces of documents as spans of characters, and
window_texts() cuts them out.

Defined cases: null and empty texts have no tokens and are in no window; null doc_ids form a shard of their own, ordered by a hash of the
text; rows equal in doc_id are ordered by a hash of the text, so equal rows tie harmlessly and each is packed; ties between cuts go to the
longest window; an empty table gives no windows.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import npwords as W
from .tables import released, with_text
from .token_counts import VOCABULARY, Encoder

#: Parameters of production.
WINDOW, SENTENCE_COST, INSIDE_COST, SHARD_SPAN = 2048, 16, 256, 4096
WINDOWS = "shard bigint, window bigint, n_tokens int, padding int, cuts_sentence boolean, doc_ids array<bigint>, starts array<int>, ends array<int>, tokens array<int>"
_CUT = np.dtype([("char", "<i4"), ("tokens", "<i4"), ("kind", "u1")])
END, SENTENCE, INSIDE = 0, 1, 2


def best_cuts(tokens: np.ndarray, cost: np.ndarray, window: int) -> np.ndarray:
    """Indices of the best cuts, the last included, of consecutive pieces of `tokens` tokens, each at most window; cost is of a cut after each."""
    n = len(tokens)
    b = [0, *np.cumsum(tokens).tolist()]
    cost = [0, *np.asarray(cost).tolist()]
    cost[n] = 0
    f = [0] * (n + 1)
    back = [0] * (n + 1)
    queue: deque[int] = deque([0])  # f(i) + b(i) increases along it
    for j in range(1, n + 1):
        while b[j] - b[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        f[j] = f[i] + b[i] + window - b[j] + cost[j]
        v = f[j] + b[j]
        while queue and f[queue[-1]] + b[queue[-1]] > v:
            queue.pop()
        queue.append(j)
    out = []
    while n:
        out.append(n - 1)
        n = back[n]
    return np.array(out[::-1], np.int64)


def _pieces(cp: np.ndarray, tok_at: np.ndarray, tok_n: np.ndarray, window: int) -> np.ndarray:
    """The possible cuts of one text of code points cp: after how many characters, tokens since the last, kind."""
    stop = (cp == 46) | (cp == 33) | (cp == 63)
    stop[:-1] &= (cp[1:] == 32) | (cp[1:] == 10) | (cp[1:] == 13) | (cp[1:] == 9)
    # A cut falls between pre-tokens, so that pieces are tokenised as the whole is.
    ends = np.flatnonzero(stop | (cp == 10)) + 1
    k = np.unique(np.minimum(np.searchsorted(tok_at, ends), len(tok_at)))
    k = k[(k > 0) & (k < len(tok_at))]
    k = np.append(k, len(tok_at))
    total = np.append(0, np.cumsum(tok_n))
    size = np.diff(np.append(0, total[k]))
    at = np.append(tok_at, len(cp))
    kind = np.full(len(k), SENTENCE, np.uint8)
    kind[-1] = END
    if (size > window).any():
        extra = []
        for i in np.flatnonzero(size > window).tolist():
            a, z = (int(k[i - 1]) if i else 0), int(k[i])
            while total[z] - total[a] > window:
                a = max(a + 1, int(np.searchsorted(total, total[a] + window, "right")) - 1)
                if a >= z:
                    break
                extra.append(a)
        k, first = np.unique(np.concatenate([k, np.array(extra, np.int64)]), return_index=True)
        kind = np.concatenate([kind, np.full(len(extra), INSIDE, np.uint8)])[first]
        size = np.diff(np.append(0, total[k]))
    out = np.empty(len(k), _CUT)
    out["char"], out["tokens"], out["kind"] = at[k], size, kind
    return out


def _split_long(cuts: np.ndarray, window: int) -> np.ndarray:
    """A single pre-token longer than a window is shared out over windows of its own, all ending where it ends."""
    if not (cuts["tokens"] > window).any():
        return cuts
    parts = []
    for c in cuts:
        left = int(c["tokens"])
        while left > window:
            p = c.copy()
            p["tokens"], p["kind"] = window, INSIDE
            parts.append(p)
            left -= window
        c = c.copy()
        c["tokens"] = left
        parts.append(c)
    return np.array(parts, _CUT)


def pack(docs: DataFrame, window: int = WINDOW, sentence_cost: int = SENTENCE_COST, inside_cost: int = INSIDE_COST, shard_span: int = SHARD_SPAN, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each window: its shard and number, its tokens and padding, and the pieces of documents in it (start and end in characters)."""
    if window < 1 or sentence_cost < 0 or inside_cost < 0 or shard_span < 1:
        raise ValueError("window and shard_span are positive, costs not negative")

    def places(batches):
        enc = Encoder.of(vocabulary)
        for b in batches:
            ids, shard, text = b.column(0), b.column(1), W.texts(b.column(3))
            blobs: list[bytes | None] = [None] * b.num_rows
            for lo, hi, cp, offs, s, e, n in enc.lengths(text):
                at = np.searchsorted(s, offs)
                for r in range(hi - lo):
                    a, z = at[r], at[r + 1]
                    if z > a:
                        blobs[lo + r] = _split_long(_pieces(cp[offs[r] : offs[r + 1]], s[a:z] - offs[r], n[a:z], window), window).tobytes()
            yield pa.RecordBatch.from_arrays([ids, shard, b.column(2), pa.array(blobs, pa.binary())], ["doc_id", "shard", "tie", "cuts"])

    def windows(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending")])
        each = [np.frombuffer(x.as_buffer(), _CUT) for x in table.column("cuts")]
        cuts = np.concatenate(each)
        doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
        start = np.append(0, cuts["char"][:-1])
        start[np.append(True, doc[1:] != doc[:-1])] = 0
        cost = np.array([0, sentence_cost, inside_cost])[cuts["kind"]]
        last = best_cuts(cuts["tokens"], cost, window)
        ids = table.column("doc_id").to_pylist()
        rows = []
        a = 0
        for w, z in enumerate((last + 1).tolist()):
            d = doc[a:z]
            f = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            l = np.append(f[1:], len(d)) - 1
            n = int(cuts["tokens"][a:z].sum())
            rows.append((key[0].as_py(), w, n, window - n, bool(cuts["kind"][z - 1] != END), [ids[d[i]] for i in f], start[a:z][f].tolist(), cuts["char"][a:z][l].tolist(), np.add.reduceat(cuts["tokens"][a:z], f).tolist()))
            a = z
        cols = list(zip(*rows))
        i32, i64 = pa.int32(), pa.int64()
        kinds = (i64, i64, i32, i32, pa.bool_(), pa.list_(i64), pa.list_(i32), pa.list_(i32), pa.list_(i32))
        return pa.table([pa.array(v, k) for v, k in zip(cols, kinds)], names=["shard", "window", "n_tokens", "padding", "cuts_sentence", "doc_ids", "starts", "ends", "tokens"])

    own = with_text(docs, "doc_id", "text").where("text is not null and text != ''")
    own = own.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.floor(F.col("doc_id") / shard_span).cast("bigint").alias("shard"), F.xxhash64("text").alias("tie"), "text")
    return own.mapInArrow(released(places), "doc_id bigint, shard bigint, tie bigint, cuts binary").where("cuts is not null").groupBy("shard").applyInArrow(windows, WINDOWS)


def window_texts(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(shard, window, text): the windows' pieces cut out of docs, whose doc_ids are unique, and joined in order."""
    piece = windows.select("shard", "window", F.posexplode(F.arrays_zip("doc_ids", "starts", "ends")).alias("k", "p"))
    piece = piece.select("shard", "window", "k", F.col("p.doc_ids").alias("doc_id"), F.col("p.starts").alias("a"), F.col("p.ends").alias("z"))
    said = piece.join(with_text(docs, "doc_id", "text"), "doc_id").withColumn("said", F.expr("substring(text, a + 1, z - a)"))
    return said.groupBy("shard", "window").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "said"))), lambda x: x["said"]), "").alias("text"))
