"""Evaluation texts inside a training corpus: prefix-filtered set join on word shingles, then exact verification.

A document leaks an item if it repeats at least 12 successive words of the item's passage or question, or at least 30
successive ones of which at most one in six was changed or dropped.

Shingles are three words, because the tolerant rule leaves no longer ones for certain: of a window of L words and L/6
edits at least L - 2 - 3L/6 shingles survive (13 at L = 30), and an exact window of 12 words has 10. Windows of 60 words
and more need no look of their own: cut into pieces of 30 to 59 words, one piece has at most its share of the edits. So:

1. One pass over the documents counts in how many of them each item shingle occurs, and keeps those with at least 10 item
   shingles, as word numbers of the items' vocabulary (a table in the shared folder), whatever the documents' length.
2. Of each item window the rarest shingle (exact rule), or the rarest 3L/6 + 1 (tolerant rule), are its necessary prefix:
   a leaking document has one of them. Rarity is the count over all documents.
3. Documents join items on prefix shingles only; the length bound (10 shared shingles) and the positional bound (hits of
   an item on diagonals close together) cut the candidates; what is left is verified exactly: runs of hits on one diagonal
   for the exact rule, edit distance for the tolerant one, in a band of 59 item words from each start, over stretches of
   the item and of the document of bounded length, so that the work grows in proportion to both.

The items are a stated query set. They are broadcast in blocks of at most block_words words as sorted arrays, so a larger
set means more passes, not a larger broadcast. Documents are never shuffled, so no key or copy can be hot.

Letter case, punctuation, spacing, line breaks, markup and escape sequences are removed first. A text with markup is read
twice, without the names, attributes and comments in it and with them, so that neither what markup interrupts nor what
stands inside markup is lost; no length of it matters. The instruction line that a suite's items share isn't part of an
item.

Defined results: null or blank texts leak nothing; items with fewer than 12 words can't be leaked; repeated documents
each give their rows; two items with the same words are both reported; without items or documents the result is empty.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut

K, EXACT, TOLERANT, ONE_IN = 3, 12, 30, 6
LEAST = EXACT - K + 1
#: The longest window that has to be looked at, the edits it may have, and the shingles that a tolerant window keeps.
WIDEST = 2 * TOLERANT - 1
MOST = WIDEST // ONE_IN
KEPT = TOLERANT - K + 1 - K * (TOLERANT // ONE_IN)
#: Item words and document words looked at in one step.
STRETCH, SEGMENT = 128, 4096
WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
#: A backslash that was escaped itself, however often, counts once.
ESCAPE = re.compile(r"\\(?:\\|[uU]005[cC]|[xX]5[cC])*+(?:u(?:\{([0-9a-fA-F]{1,6})\}|([0-9a-fA-F]{4}))|x([0-9a-fA-F]{2})|[nrtbfv0]|([\"'/]))?")
AMP = re.compile(r"&(?:(?:amp|#38|#[xX]26);)+")
PERCENT = re.compile(r"(?:%(?:25)*[0-9a-fA-F]{2})+")
SPLIT = re.compile(r"(?<=\w)(?:\u00ad|[-\u2010][ \t]*\r?\n[ \t]*(?:(?://|#|>|\*|--)[ \t]*)?)(?=\w)")


def _escape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if code:
        return chr(int(code, 16)) if int(code, 16) < 0x110000 else " "
    return m[4] or " "


def _percent(m: re.Match) -> str:
    raw = bytes(int(x, 16) for x in re.findall(r"%(?:25)*([0-9a-fA-F]{2})", m[0]))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def _uncommented(text: str) -> str:
    """The text without comments of markup, whatever their length."""
    out, at = [], 0
    while (lo := text.find("<!--", at)) >= 0 and (hi := text.find("-->", lo + 4)) >= 0:
        out += [text[at:lo], " "]
        at = hi + 3
    return "".join([*out, text[at:]])


def plain(text: str) -> str:
    """The text without escape sequences and entities."""
    if "\\" in text:
        text = ESCAPE.sub(_escape, text)
    if "&" in text and ";" in text:
        text = html.unescape(AMP.sub("&", text))
    if "%" in text:
        text = PERCENT.sub(_percent, text)
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def _words(text: str) -> list[str]:
    return WORD.findall((SPLIT.sub("", text) if "\n" in text or "\u00ad" in text else text).lower())


def readings(text: str | None) -> list[list[str]]:
    """The words of a text without its markup, and where there is any also with what stands inside of it."""
    if not text:
        return []
    s = plain(text)
    if "<" not in s:
        return [_words(s)]
    bare, whole = _words(TAG.sub(" ", _uncommented(s))), _words(s)
    return [bare] if bare == whole else [bare, whole]


def words(text: str | None) -> list[str]:
    """The words of a text without its markup."""
    return next(iter(readings(text)), [])


def passages(items: list[tuple[int, str | None, str | None]]) -> dict[int, list[str]]:
    """The words of each item without the instruction line of its suite (what all its items begin with, up to a sentence's end)."""
    suites: dict = defaultdict(list)
    for i, suite, text in items:
        suites[suite].append((i, text or ""))
    out = {}
    for own in suites.values():
        texts = sorted({t for _, t in own})
        a, b = texts[0], texts[-1]
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) if len(texts) > 1 else 0
        ends = [m.end() for m in re.finditer(r"[.!?:](?:\s|$)|\n", a[:n])]
        if len(texts) == 1:
            first = re.search(r"[.!?:]\s|\n", a)
            ends = [first.end()] if first else []
        for i, t in own:
            out[i] = words(t[ends[-1] if ends else 0 :])
    return out


class Index:
    """The items' vocabulary and their shingles as sorted arrays; with the corpus counts also which of them are prefixes."""

    def __init__(self, items: dict[int, list[str]]):
        import numpy as np

        kept = {i: ws for i, ws in sorted(items.items()) if len(ws) >= EXACT}
        self.vocab = {w: k for k, w in enumerate(sorted({w for ws in kept.values() for w in ws}))}
        self.none = len(self.vocab)
        self.base = self.none + 1
        self.ids = np.array(list(kept), dtype=np.int64)
        self.items = [self.numbers(ws) for ws in kept.values()]
        codes = [self.codes(ws) for ws in self.items]
        item = np.repeat(np.arange(len(codes), dtype=np.int32), [len(c) for c in codes])
        q = np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes]) if codes else np.zeros(0, dtype=np.int32)
        flat = np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64)
        #: sorted[k] is the place in item order of the k-th entry in order of the shingles
        self.sorted = np.argsort(flat, kind="stable")
        self.item, self.q = item[self.sorted], q[self.sorted]
        self.known, self.first = np.unique(flat[self.sorted], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.prefix = np.zeros(len(flat), dtype=bool)

    def codes(self, ids):
        return (ids[:-2] * self.base + ids[1:-1]) * self.base + ids[2:] if len(ids) >= K else ids[:0]

    def numbers(self, ws: list[str]):
        import numpy as np

        get, none = self.vocab.get, self.none
        return np.fromiter((get(w, none) for w in ws), dtype=np.int64, count=len(ws))

    def hits(self, ids):
        """(positions, number of the known shingle) of the document's shingles that some item has."""
        import numpy as np

        c = self.codes(ids)
        if not len(c) or not len(self.known):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.known, c), len(self.known) - 1)
        p = np.flatnonzero(self.known[at] == c)
        return p, at[p]

    def order(self, counts) -> None:
        """The necessary prefixes, given in how many documents each known shingle occurs."""
        import numpy as np

        flags, at = np.zeros(len(self.item), dtype=bool), 0
        number = np.repeat(np.arange(len(self.known)), np.diff(self.first))
        rarity = np.empty(len(self.item), dtype=np.int64)
        # by count, then by shingle: one order for all windows
        rarity[self.sorted] = np.lexsort((np.arange(len(self.known)), counts)).argsort()[number] if len(number) else 0
        for ws in self.items:
            m = max(0, len(ws) - K + 1)
            rank = rarity[at : at + m]
            for size, take in [(EXACT, 1), *((n, K * (n // ONE_IN) + 1) for n in range(TOLERANT, WIDEST + 1, ONE_IN))]:
                n = size - K + 1
                for lo in range(0, m - n + 1, 65_536):
                    seen = np.lib.stride_tricks.sliding_window_view(rank[lo : min(m, lo + 65_536 + n - 1)], n)
                    best = np.argpartition(seen, min(take, n) - 1, axis=1)[:, :take]
                    flags[at + lo + (best + np.arange(len(seen))[:, None]).ravel()] = True
            at += m
        self.prefix = flags[self.sorted]

    def leaked(self, ids) -> list[int]:
        """The items that a document with these word numbers leaks."""
        import numpy as np

        out: set[int] = set()
        for lo in range(0, max(1, len(ids)), SEGMENT):  # any window lies in one segment and what hangs over
            out |= self._leaked(ids[lo : lo + SEGMENT + 2 * WIDEST], out)
            if lo + SEGMENT + 2 * WIDEST >= len(ids):
                break
        return sorted(int(x) for x in self.ids[np.fromiter(out, dtype=np.int64, count=len(out))]) if out else []

    def _leaked(self, ids, known: set[int]) -> set[int]:
        import numpy as np

        at, number = self.hits(ids)
        if not len(at):
            return set()
        n = self.first[number + 1] - self.first[number]
        p = np.repeat(at, n)
        place = np.repeat(self.first[number], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        candidate = np.zeros(len(self.items), dtype=bool)
        candidate[self.item[place[self.prefix[place]]]] = True
        if known:
            candidate[list(known)] = False
        keep = candidate[self.item[place]]
        p, item, q = p[keep], self.item[place[keep]].astype(np.int64), self.q[place[keep]].astype(np.int64)
        order = np.lexsort((p, p - q, item))
        p, item, q = p[order], item[order], q[order]
        out: set[int] = set()
        ends = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
        for a, b in zip(ends[:-1], ends[1:]):
            mine = slice(a, b)
            if len(np.unique(q[mine])) >= LEAST and (self.run(p[mine], q[mine]) or self.tolerant(self.items[item[a]], ids, p[mine], q[mine])):
                out.add(int(item[a]))
        return out

    @staticmethod
    def run(p, q) -> bool:
        """Whether the hits, ordered by diagonal and position, hold a run of EXACT words on one diagonal."""
        import numpy as np

        goes_on = (np.diff(p) == 1) & (np.diff(q) == 1)
        if len(goes_on) < LEAST - 1:
            return False
        total = np.concatenate([[0], np.cumsum(goes_on)])
        return bool((total[LEAST - 1 :] - total[: len(total) - LEAST + 1] == LEAST - 1).any())

    @staticmethod
    def tolerant(item, ids, p, q) -> bool:
        """Whether some window of TOLERANT words or more is in the document with at most one word in ONE_IN changed or dropped."""
        import numpy as np

        if len(item) < TOLERANT:
            return False
        band = 2 * MOST + 1  # hits of one window lie on so many neighbouring diagonals
        diagonal = (p - q) // band
        for d in np.unique(np.concatenate([diagonal, diagonal - 1])):
            near = (diagonal == d) | (diagonal == d + 1)  # any band lies in two neighbouring ones
            pn, qn = p[near], q[near]
            if len(np.unique(qn)) < KEPT:
                continue
            for lo in range((int(qn.min()) - WIDEST) // STRETCH * STRETCH, int(qn.max()) + 1, STRETCH):
                inside = (qn >= lo) & (qn < lo + STRETCH + WIDEST)  # what windows that start in the stretch can hit
                if len(np.unique(qn[inside])) < KEPT:
                    continue
                starts = np.arange(max(0, lo), min(lo + STRETCH, len(item) - TOLERANT + 1))
                if len(starts) and Index._near(item, ids[max(0, int(pn[inside].min()) - WIDEST - MOST) : int(pn[inside].max()) + K + WIDEST + MOST], starts):
                    return True
        return False

    @staticmethod
    def _near(item, part, starts) -> bool:
        """Whether a window of TOLERANT to WIDEST words from one of these starts is in the part with its share of edits."""
        import numpy as np

        length = np.arange(WIDEST + 1)
        own = np.full((len(starts), WIDEST), -1, dtype=np.int64)  # the item's words from each start
        at = starts[:, None] + np.arange(WIDEST)[None, :]
        inside = at < len(item)
        own[inside] = item[at[inside]]
        allowed = np.where(length >= TOLERANT, length // ONE_IN, -1)[None, :].repeat(len(starts), axis=0)
        allowed[:, 1:][~inside] = -1
        first = np.broadcast_to(length, allowed.shape).astype(np.int16)
        cost, length = first.copy(), length.astype(np.int16)
        for w in part:
            step = cost + np.int16(1)  # a word of the document that isn't the item's
            step[:, 1:] = np.minimum(step[:, 1:], cost[:, :-1] + (own != w))
            step = np.minimum(step, first)  # a window may begin anywhere in the document
            cost = np.minimum.accumulate(step - length, axis=1) + length  # dropped words
            if (cost <= allowed).any():
                return True
        return False


def _block(docs: DataFrame, index: Index) -> DataFrame:
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(index)
    kept = "doc_id long, numbers array<int>, shingles array<int>, counts array<int>"

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        ix = held.value
        counts = np.zeros(len(ix.known), dtype=np.int64)

        def batch(ids, numbers, shingles, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(shingles, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["doc_id", "numbers", "shingles", "counts"])

        for b in batches:
            ids, near = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r, ws in enumerate(readings(t)):
                    n = ix.numbers(ws)
                    at, number = ix.hits(n)
                    if r == 0:
                        counts[np.unique(number)] += 1
                    if len(at) >= LEAST:
                        ids.append(i)
                        near.append(n.astype("int32"))
            if ids:
                yield batch(ids, near, [None] * len(ids), [None] * len(ids))
        seen = np.flatnonzero(counts)
        yield batch([None], [None], [seen.astype("int32")], [counts[seen].astype("int32")])

    passed = cut(docs.mapInArrow(scan, kept))
    pairs = passed.where("shingles is not null").select(F.explode(F.arrays_zip("shingles", "counts")).alias("x"))
    counted = pairs.groupBy("x.shingles").agg(F.sum("x.counts").alias("docs"))
    import numpy as np

    docs_of = np.zeros(len(index.known), dtype=np.int64)
    for r in counted.toLocalIterator():  # at most the items' own shingles
        docs_of[r.shingles] = r.docs
    index.order(docs_of)
    ordered = spark.sparkContext.broadcast(index)

    def verify(batches):
        import numpy as np
        import pyarrow as pa

        ix = ordered.value
        for b in batches:
            out = [(d, i) for d, n in zip(b.column(0).to_pylist(), b.column(1)) for i in ix.leaked(np.asarray(n.values, dtype=np.int64))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "item_id"])

    return passed.where("numbers is not null").select("doc_id", "numbers").mapInArrow(verify, "doc_id long, item_id long")


def leaks(documents: DataFrame, items: DataFrame, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id) of every document that repeats a passage of an item."""
    spark = documents.sparkSession
    docs = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stated = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "suite", "text").distinct()
    own = passages([(r.item_id, r.suite, r.text) for r in stated.toLocalIterator()])
    out, block, size = [], {}, 0
    for i, ws in sorted(own.items()):
        block[i] = ws
        size += len(ws)
        if size >= block_words:
            out.append(_block(docs, Index(block)))
            block, size = {}, 0
    if block:
        out.append(_block(docs, Index(block)))
    if not out:
        return spark.createDataFrame([], "doc_id long, item_id long")
    df = out[0]
    for x in out[1:]:
        df = df.unionByName(x)
    return df.distinct()
