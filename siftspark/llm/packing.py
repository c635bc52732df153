"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

One bin is open at a time. Of a bounded pool of pending examples the one whose demand
vector has the largest dot product with the bin's remaining capacity goes in next, so
examples fill those dimensions that the bin has most of. If none fits whole, the best is
cut to what is left. A bin that closes short is cut into sequences whose lengths are
powers of two, which need no padding. Every task packs the rows it reads in one pass:
no shuffle, and a pool of bounded size whatever the input.
"""

from __future__ import annotations

import string
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pending examples of a task.
POOL = 256
#: Stretches of a generation of an encoder's cache, which holds this one and the last, some 200 bytes each; the longest stretch that is cached.
WORDS, LONGEST = 150_000, 40
#: Letters that have one lower-case form and stand alone in every normal form: ASCII, Latin-1, Cyrillic; a stretch of them, with or without ASCII punctuation after it.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0400-\u045f]"
SIMPLE = f"^{LETTERS}+" + r"[!-/:-@\[-`{-~]*$"
#: Texts that are taken from a batch at once, and their bytes: a part has more only if it is one text.
TEXTS, TEXT_BYTES = 512, 2 << 20
END = 2


class Encoder:
    """Token ids of texts; a batch's distinct stretches between blanks and newlines are encoded once and remembered.

    Ids are those that the tokenizer as loaded gives with add_special_tokens=False, its added
    tokens included. Exact for tokenizers whose pre-tokens never reach over a blank or newline
    and whose normaliser works on each stretch alone; one with an added token that holds or
    strips white space encodes texts whole. A stretch of letters, with or without punctuation
    after it, is one pre-token or two: of these the letters go to the tokenizer's model
    directly, in lower case and as the byte alphabet that it is made of. What is remembered
    of a stretch are its ids as bytes, little-endian, four an id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = any(t.lstrip or t.rstrip or t.single_word or t.normalized or any(map(str.isspace, t.content)) for t in added)
        self.by_letters = "ByteLevel" in str(self.tokenizer.pre_tokenizer) and "Lowercase" in str(self.tokenizer.normalizer) and not any(t.content.isalpha() for t in added)
        self.tokenize = self.tokenizer.model.tokenize
        self.ids = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.held: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the last generation: what is used of it moves on, the rest goes with it
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet: these stand for themselves, the rest for 256 and up
        self.alphabet = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*printed})) if b != 32}  # a blank parts words

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]

    def _letters(self, words: list[str]) -> list[bytes]:
        words, tokenize, ids = list(words), self.tokenize, self.ids
        if odd := [k for k, x in enumerate(words) if not x.isascii()]:
            mapped = " ".join([words[k] for k in odd]).encode().decode("latin-1").translate(self.alphabet).split(" ")
            for k, x in zip(odd, mapped, strict=True):
                words[k] = x
        return [b"".join([ids[t.id] for t in tokenize(x)]) for x in words]

    def _each(self, keys: list[str], encode) -> list[bytes]:
        """What encode gives for the keys, remembered."""
        out = list(map(self.held.get, keys))
        missing = [k for k, x in enumerate(out) if x is None]
        new = [k for k in missing if keys[k] not in self.old]
        for k, found in zip(new, encode([keys[k] for k in new]), strict=True):
            out[k] = found
        for k in missing:
            if out[k] is None:
                out[k] = self.old[keys[k]]
        kept = {keys[k]: out[k] for k in missing if len(keys[k]) <= LONGEST}
        if len(self.held) + len(kept) > WORDS:
            self.old, self.held = self.held, {}
        self.held |= kept
        return out

    def _pieces(self, words: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of pieces, the first of them none, and the numbers of each word's two pieces."""
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        simple = pc.match_substring_regex(words, SIMPLE).to_numpy(zero_copy_only=False) if self.by_letters else np.zeros(len(words), bool)
        chosen = words.filter(pa.array(simple))
        cores = pc.utf8_lower(pc.ascii_rtrim(chosen, characters=string.punctuation)).dictionary_encode()
        tails = pc.replace_substring_regex(chosen, f"^{LETTERS}+", "").dictionary_encode()
        strings = lambda x: x.to_numpy(zero_copy_only=False).tolist()
        pieces = [b"", *self._each(strings(cores.dictionary), self._letters)]
        first[simple], second[simple] = cores.indices.to_numpy() + 1, tails.indices.to_numpy() + len(pieces)
        pieces += self._plain(strings(tails.dictionary))
        rest = strings(words.filter(pa.array(~simple)))
        first[~simple] = np.arange(len(pieces), len(pieces) + len(rest))
        return pieces + self._each(rest, self._plain), first, second

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null text is empty."""
        texts = pc.fill_null(texts, "")
        if self.whole:
            return [np.frombuffer(x, "<u4") for x in self._plain(texts.to_pylist())]
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        pieces, first, second = self._pieces(words.dictionary)
        sizes, index = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4, words.indices.to_numpy()
        at = np.empty(2 * len(index), np.int64)
        at[0::2], at[1::2] = first[index], second[index]
        n = sizes[at]
        ends = np.cumsum(n)
        places = np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - n), n)
        places += np.arange(len(places))
        ids = np.frombuffer(b"".join(pieces), "<u4")[places]
        return np.split(ids, np.concatenate(([0], ends))[2 * np.cumsum(pc.list_value_length(lists).to_numpy())][:-1])


def _encoder(path: str) -> Encoder:
    """The encoder of a worker process, which keeps its words from task to task."""
    held = sys.modules.setdefault("_siftspark_held", types.ModuleType("_siftspark_held")).__dict__
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


class Packer:
    """Packs the examples of one task; put() and flush() give closed sequences as lists of (row, start, length)."""

    def __init__(self, tokens: int, segments: int, loss: int, pool: int = POOL):
        self.limits = np.array([tokens, segments, loss], float)
        self.pool = pool
        self.rows: list[tuple] = []  # (row, start, tokens left, cumulative loss or None)
        self.need = np.zeros((pool + 1, 3))  # demand of rows[i]
        self.bin: list[tuple] = []
        self.left = self.limits.copy()

    @staticmethod
    def _loss(cumulative, start: int, end: int) -> int:
        return end - start if cumulative is None else int(cumulative[end] - cumulative[start])

    def put(self, row, n: int, cumulative=None) -> Iterator[list[tuple]]:
        """Adds an example of n tokens; cumulative[i]: loss-bearing ones among its first i (None: all are)."""
        if n == 0:
            return
        self.need[len(self.rows)] = n, 1, self._loss(cumulative, 0, n)
        self.rows.append((row, 0, n, cumulative))
        while len(self.rows) > self.pool:
            yield from self._step()

    def flush(self) -> Iterator[list[tuple]]:
        while self.rows:
            yield from self._step()
        yield from self._close()

    def _step(self) -> Iterator[list[tuple]]:
        """Places one example or the part of one that fits, closing the bin if nothing does."""
        need = self.need[: len(self.rows)]
        gain = (need / self.limits) @ (self.left / self.limits)
        whole = (need <= self.left).all(axis=1)
        if whole.any():
            at = int(np.argmax(np.where(whole, gain, -1.0)))
            cut = self.rows[at][2]
        else:
            at = int(np.argmax(gain))
            cut = self._prefix(at)
        if cut <= 0:
            yield from self._close()
            return
        row, start, n, cumulative = self.rows[at]
        used = self._loss(cumulative, start, start + cut)
        self.bin.append((row, start, cut))
        self.left -= (cut, 1, used)
        if cut == n:
            self.rows[at] = self.rows[-1]
            self.need[at] = self.need[len(self.rows) - 1]
            self.rows.pop()
        else:
            self.rows[at] = (row, start + cut, n - cut, cumulative)
            self.need[at] -= (cut, 0, used)
        if self.left[0] < 1 or self.left[1] < 1:
            yield from self._close()

    def _prefix(self, at: int) -> int:
        """Tokens of example at that fit the open bin."""
        _, start, n, cumulative = self.rows[at]
        if self.left[1] < 1:
            return 0
        most = min(n, int(self.left[0]))
        if cumulative is None:
            return min(most, int(self.left[2]))
        return min(most, int(np.searchsorted(cumulative, cumulative[start] + self.left[2], side="right")) - 1 - start)

    def _close(self) -> Iterator[list[tuple]]:
        """The bin, cut into sequences of powers of two unless it is full."""
        pieces, self.bin = self.bin[::-1], []
        total = int(self.limits[0] - self.left[0])
        self.left = self.limits.copy()
        while total:
            length = total if total == self.limits[0] else 1 << (total.bit_length() - 1)
            total -= length
            out = []
            while length:
                row, start, n = pieces.pop()
                take = min(n, length)
                out.append((row, start, take))
                length -= take
                if take < n:
                    pieces.append((row, start + take, n - take))
            yield out


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in parts of bounded rows and, but for single rows, bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False) if pa.types.is_string(batch.schema.field(1).type) else np.zeros(batch.num_rows)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + TEXTS]), TEXT_BYTES, side="right")))
        yield batch.slice(at, n)
        at += n


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def _pack(kind: str, path: str | None, limits: tuple[int, int, int], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence = Packer(*limits), TaskContext.get().partitionId() << 33
        many: list[tuple] = []

        def take(closed) -> None:
            nonlocal sequence
            for pieces in closed:
                offset, total = 0, sum(n for *_, n in pieces)
                for (key, ids), start, n in pieces:
                    part = ids[start : start + n]
                    many.append((key, start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids), sequence, offset, total, part if with_ids else None))
                    offset += n
                sequence += 1

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array([x[k] for x in many], pa.int64()) for k in range(1, 8)]
            extra = [pa.array([x[8] for x in many], pa.list_(pa.int64()))] if with_ids else []
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in many], kind_of), *columns, *extra], names=["id", *(c.split()[0] for c in PIECES.split(", ")), *(["ids"] if with_ids else [])])
            many.clear()
            return out

        kind_of, encoder = None, None if path is None else _encoder(path)
        for batch in batches:
            kind_of = batch.schema.field(0).type
            for part in _parts(batch):
                keys = part.column(0).to_pylist()
                if encoder is not None:
                    found = [(np.append(ids, np.uint32(END)), None) for ids in encoder.encode(part.column(1))]
                else:
                    found = [(np.asarray(ids or [], np.uint32), None if mask is None else np.concatenate(([0], np.cumsum([bool(m) for m in mask])))) for ids, mask in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                for key, (ids, cumulative) in zip(keys, found, strict=True):
                    take(packer.put((key, ids), len(ids), cumulative))
                if len(many) >= 2000:
                    yield batch_of()
        take(packer.flush())
        if many:
            yield batch_of()

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, tokens: int = 4096, segments: int = 32, loss: int | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens[, ids]) of packed texts.

    A text is the ids that the tokenizer file gives it and an end id; all bear loss. A null
    text is empty: its end id alone. No sequence is longer than tokens, has more than segments
    pieces or, with loss given, more loss-bearing ids; sequences shorter than tokens have a
    power of two of them. Each id lies in one piece; repeated rows and null ids are packed
    row by row. An empty table gives no pieces. Sequence ids are unique over all tasks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    limits = (tokens, segments, loss or tokens)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pack(kind, tokenizer or default_tokenizer(), limits, with_ids), f"id {kind}, {PIECES}" + ", ids array<long>" * with_ids)


def pack_examples(examples: DataFrame, id_col: str, ids_col: str, loss_col: str, tokens: int = 4096, segments: int = 512, loss: int = 4096, with_ids: bool = True) -> DataFrame:
    """Packs instruction examples: ids (array of int) with a mask of loss-bearing ones (array of boolean; null: all).

    Results are as in pack_texts. A null or empty list of ids has no piece.
    """
    kind = examples.schema[id_col].dataType.simpleString()
    rows = examples.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<long>").alias("ids"), F.col(loss_col).cast("array<boolean>").alias("loss"))
    return rows.mapInArrow(_pack(kind, None, (tokens, segments, loss), with_ids), f"id {kind}, {PIECES}" + ", ids array<long>" * with_ids)
