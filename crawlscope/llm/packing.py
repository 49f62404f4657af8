"""Packing token sequences by vector bin packing with the dot-product heuristic."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing

if TYPE_CHECKING:
    from tokenizers import Tokenizer

LIMIT = 4096
END_ID = 2
#: Examples that compete for the places of a sequence, and the characters at which a pool is full.
POOL, POOL_CHARS = 1024, 1 << 24
#: Characters that are split into words at a time.
BLOCK_CHARS = 1 << 20
#: Words that the tokenizer gets at a time; what it returns takes far more memory than their ids.
ENCODED = 2_000
#: Words whose ids a Python worker remembers between blocks.
MEMO = 700_000
#: White space as the tokenizer sees it: four separators count as text.
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")

_memo: dict[str, dict[str, bytes]] = {}


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple[Tokenizer, np.ndarray]:
    """The tokenizer, and which of its ids end a word; a worker loads them once, for all its tasks.

    Tasks fill the cores already: threads of the tokenizer's own would each keep memory apart.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return tokenizer, ends


@dataclass
class Example:
    """Tokens ``start..end`` of a document are still to place; those from ``loss_from`` bear loss."""

    key: int
    start: int
    end: int
    loss_from: int

    def vector(self) -> tuple[int, int, int]:
        return self.end - self.start, 1, max(0, self.end - max(self.start, self.loss_from))


class Packer:
    """Fills one sequence after another from a pool of examples.

    Capacities are tokens, segments and loss-bearing tokens. The open sequence takes the example
    whose vector has the largest dot product with what is left of its capacities, among those that
    fit. When none fits and cutting is allowed, the head of the longest example that has a token to
    give fills the gap. Examples longer than a sequence are always cut.
    """

    def __init__(self, limit: int, max_segments: int, max_loss: int, cut: bool):
        self.caps = np.array([limit, max_segments, max_loss], dtype=np.float64)
        self.cut = cut
        self.open: list[tuple[int, int, int]] = []
        self.used = np.zeros(3)

    def _put(self, e: Example, length: int) -> None:
        piece = Example(e.key, e.start, e.start + length, e.loss_from)
        self.open.append((e.key, e.start, length))
        self.used += piece.vector()
        e.start += length

    def _fits(self, e: Example) -> int:
        """Tokens of the head of ``e`` that the open sequence still takes."""
        left = self.caps - self.used
        if left[1] < 1:
            return 0
        free = max(0, e.loss_from - e.start)
        return int(min(left[0], free + left[2], e.end - e.start))

    def _close(self) -> list[tuple[int, int, int]]:
        done, self.open, self.used = self.open, [], np.zeros(3)
        return done

    def pack(self, pool: list[Example]) -> Iterator[list[tuple[int, int, int]]]:
        """Full sequences; what is left of the last one stays open for the next pool."""
        vectors = np.array([e.vector() for e in pool], dtype=np.float64).reshape(-1, 3)
        alive = np.ones(len(pool), dtype=bool)
        while alive.any():
            left = self.caps - self.used
            fit = alive & (vectors <= left).all(axis=1)
            if fit.any():
                worth = (vectors / self.caps) @ (left / self.caps)
                i = int(np.where(fit, worth, -1.0).argmax())
                self._put(pool[i], pool[i].end - pool[i].start)
                alive[i] = False
            else:
                i = int(np.where(alive, vectors[:, 0], -1.0).argmax())
                too_long = bool((vectors[i] > self.caps).any())
                take = self._fits(pool[i]) if self.cut or (too_long and not self.open) else 0
                if take:
                    self._put(pool[i], take)
                    vectors[i] = pool[i].vector()
                else:
                    yield self._close()
                    continue
            if self.used[0] >= self.caps[0]:
                yield self._close()

    def finish(self) -> Iterator[list[tuple[int, int, int]]]:
        """The open rest; if cutting is allowed, as sequences whose lengths are powers of two."""
        rest = self._close()
        total = sum(n for _, _, n in rest)
        if not self.cut:
            if rest:
                yield rest
            return
        rest = rest[::-1]
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            out = []
            while size:
                key, start, n = rest.pop()
                take = min(n, size)
                out.append((key, start, take))
                size -= take
                if take < n:
                    rest.append((key, start + take, n - take))
            yield out


def _words(text: str) -> list[str]:
    """Pieces between white space."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def _parts(text: str) -> Iterator[str]:
    """``text``, cut at white space where it is longer than a block."""
    at = 0
    while len(text) - at > BLOCK_CHARS and (gap := _SPACE.search(text, at + BLOCK_CHARS)):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes, through a bounded word memo.

    The tokenizer drops white space and never joins across it, so that a text's ids are those of its
    words one after another; a frequent word is encoded once per worker. It also lower-cases and
    parts letters from marks, so that a Latin word shares the entry of its lower case, and one
    before a stop has the entries of both. New lower-case words are encoded many at a time: each of
    them ends with the only token of its own that bears the end-of-word mark.
    """

    def __init__(self, path: str, end_id: int, most: int = MEMO):
        self.tokenizer, self.ends = _tokenizer(path)
        self.memo = _memo.setdefault(path, {})
        self.most = most
        self.end = np.array([end_id], dtype="<u4").tobytes()

    def _each(self, words: list[str]) -> None:
        for at in range(0, len(words), ENCODED):
            part = words[at : at + ENCODED]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memo[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _together(self, words: list[str]) -> None:
        for at in range(0, len(words), ENCODED):
            part = words[at : at + ENCODED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(part) or cuts[-1] != 4 * len(ids):
                self._each(part)
                continue
            data, start = ids.tobytes(), 0
            for w, end in zip(part, cuts.tolist(), strict=True):
                self.memo[w] = data[start:end]
                start = end

    def _learn(self, new: set[str]) -> set[str]:
        """Enter ``new`` in the memo; returns all that was entered."""
        memo, plain, other, made = self.memo, set(), [], []
        for w in new:
            low, tail = w.lower(), ""
            if low[-1] in ".,;:!?":
                low, tail = low[:-1], low[-1]
            if low.isalpha() and max(w) < "\u0250":
                if low not in memo:
                    plain.add(low)
                if tail or low != w:
                    made.append((w, low, tail))
            else:
                other.append(w)
        stops = [c for c in ".,;:!?" if c not in memo]
        self._each(other + stops)
        self._together(sorted(plain))
        for w, low, tail in made:
            memo[w] = memo[low] + (memo[tail] if tail else b"")
        return new | plain

    def _add(self, block: list[tuple[int, str]], found: list[list[bytes]]) -> None:
        """Add the ids of each text of ``block`` to those found for its number."""
        split = [_words(t) for _, t in block]
        memo = self.memo
        new = set(chain.from_iterable(split)).difference(memo)
        entered = self._learn(new) if new else new
        get = memo.__getitem__
        for (i, _), words in zip(block, split, strict=True):
            found[i].append(b"".join(map(get, words)))
        over = len(memo) - self.most
        if over > 0:
            # Frequent words come early and stay.
            for w in islice(entered, over):
                del memo[w]

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, a block of words at a time, and the end's."""
        found: list[list[bytes]] = [[] for _ in texts]
        block, size = [], 0
        for i, text in enumerate(texts):
            for part in _parts(text or ""):
                block.append((i, part))
                size += len(part)
                if size >= BLOCK_CHARS:
                    self._add(block, found)
                    block, size = [], 0
        self._add(block, found)
        return [b"".join([*parts, self.end]) for parts in found]


def _pools(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most POOL rows that end where their texts reach POOL_CHARS bytes."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns[1:]:
        size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    full, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = full[at - 1] if at else 0
        end = min(at + POOL, int(np.searchsorted(full, before + POOL_CHARS)) + 1, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def pack_texts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = LIMIT,
    max_segments: int = LIMIT,
    max_loss: int | None = None,
    cut: bool = True,
    end_id: int = END_ID,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    memo: int = MEMO,
) -> DataFrame:
    """Pieces of the tokenised texts of ``docs``, placed in sequences of at most ``limit`` tokens.

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_loss[, ids]): the
    tokens ``start`` to ``start + length`` of the document lie at ``offset`` of the sequence. A
    document's tokens are those of its text and ``end_id``; with ``prompt_col`` those of the prompt
    come first and bear no loss. A sequence obeys all three limits. With ``cut`` examples are cut to
    fill gaps, and each partition's rest becomes sequences with powers of two for lengths, so that
    no padding is left unless the segment or loss limit binds. A worker remembers the ids of ``memo`` words.

    Each partition packs its own rows as they stream by: nothing is shuffled, memory holds at most
    POOL documents, fewer where they are long, and a lost task that runs again yields the same pieces and sequence ids. Null texts
    are empty and give ``end_id`` alone; repeated rows and null ids are packed each by itself. No
    rows give no rows; other columns are ignored, whatever their names.
    """
    max_loss = limit if max_loss is None else max_loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        seq = (context.partitionId() if context else 0) << 40
        ids_of, packer = Ids(tokenizer_path, end_id, memo), Packer(limit, max_segments, max_loss, cut)
        held: dict[int, tuple[int | None, bytes, int]] = {}
        n_seen = 0

        def rows(sequences: Iterator[list[tuple[int, int, int]]]) -> list[tuple]:
            nonlocal seq
            out = []
            for pieces in sequences:
                offset = 0
                for key, start, n in pieces:
                    doc_id, ids, loss_from = held[key]
                    part = ids[4 * start : 4 * (start + n)]
                    out.append((doc_id, start, n, zlib.crc32(part), len(ids) // 4, seq, offset, max(0, start + n - max(start, loss_from)), part))
                    offset += n
                seq += 1
            return out

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 8 + [pa.binary()]
            n = 9 if with_ids else 8
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds[:n], strict=True)], names=names[:n])

        for batch in batches:
            for part in _pools(batch):
                doc_ids, ids = part.column(0).to_pylist(), ids_of.of(part.column(1).to_pylist())
                prompts = [b[:-4] for b in ids_of.of(part.column(2).to_pylist())] if prompt_col else [b""] * len(ids)
                pool = []
                for doc_id, text, prompt in zip(doc_ids, ids, prompts, strict=True):
                    held[n_seen] = (doc_id, prompt + text, len(prompt) // 4)
                    pool.append(Example(n_seen, 0, len(prompt + text) // 4, len(prompt) // 4))
                    n_seen += 1
                found = rows(packer.pack(pool))
                waiting = {key for key, _, _ in packer.open}
                held = {k: v for k, v in held.items() if k in waiting}
                del ids, prompts, pool
                if found:
                    out, found = batch_of(found), []
                    yield out
                    del out
        found = rows(packer.finish())
        if found:
            yield batch_of(found)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss", "ids"]
    schema = ", ".join(f"{c} long" for c in names[:8]) + (", ids binary" if with_ids else "")
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")] + ([F.col(prompt_col).alias("prompt")] if prompt_col else [])
    return docs.select(*cols).mapInArrow(releasing(run), schema)
