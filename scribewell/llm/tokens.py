"""Token counts: whole texts through a public tokenizer in Arrow functions that return lengths only.

Texts are split at boundaries that no token crosses. The distinct words of a batch are encoded in
calls of about equal bytes, each word once, and a text's tokens are put together from its words'.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: A single space between two characters that are no white space. Byte-level pre-tokenizers start a
#: piece at such a space whatever stands before it, so the tokens of both sides don't depend on each other.
SAFE = re.compile(r" (?=\S)(?<=\S )")
#: Latin letters, and ASCII punctuation after them.
LATIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")
#: Byte-level BPE writes each byte as a character: printable Latin-1 as itself, the others from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LEVEL = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: UTF-8 bytes in one call of the library.
CALL_BYTES = 1 << 16
#: A worker remembers words of up to so many characters, and so many of them.
WORD_CHARS, REMEMBERED = 40, 300_000
#: And so many runs of letters, which come with various punctuation.
RUNS = 500_000
#: UTF-8 bytes of the texts whose words are handled together.
GROUP_BYTES = 1 << 22


def balanced(texts: Iterable[str], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """Lists of texts of up to ``most`` bytes each; a longer text comes alone."""
    group: list[str] = []
    size = 0
    for x in texts:
        n = len(x) if x.isascii() else len(x.encode())
        if group and size + n > most:
            yield group
            group, size = [], 0
        group.append(x)
        size += n
    if group:
        yield group


def parts(text: str, most: int = CALL_BYTES) -> Iterator[str]:
    """``text`` in parts of about ``most`` characters, cut at safe boundaries only: their tokens are its tokens."""
    begin = 0
    while len(text) - begin > most:
        cut = SAFE.search(text, begin + most)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of up to ``most`` bytes; a longer text comes alone."""
    begin, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if len(texts) > begin:
        yield begin, len(texts)


class TextEncoder:
    """Token ids, or only their number, of whole texts, the same as one call of the library for each text."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        self.marks: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.ids, self.ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]

    def whole(self, text: str) -> np.ndarray:
        found = [e.ids for g in balanced(parts(text)) for e in self.tokenizer.encode_batch_fast(g, add_special_tokens=False)]
        return np.concatenate([np.array(x, np.uint32) for x in found]) if found else np.zeros(0, np.uint32)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that follow a space each, and where each word's ids end.

        Latin letters are one piece for the byte-level pre-tokenizer, and the punctuation after
        them is the next, so these go to the library's BPE model at once; the others go through all
        of the library, many to a call, where offsets tell whose the tokens are.
        """
        found: list = [None] * len(words)
        others = []
        bpe, marks, runs, latin = self.tokenizer.model.tokenize, self.marks, self.runs, LATIN.fullmatch
        for i, word in enumerate(words):
            if m := latin(word):
                letters, mark = m.groups()
                if (ids := runs.get(letters)) is None:
                    plain = letters if letters.isascii() else letters.encode().decode("latin-1").translate(BYTE_LEVEL)
                    ids = array("I", [t.id for t in bpe("\u0120" + plain)]).tobytes()
                    if len(letters) <= WORD_CHARS and len(runs) < RUNS:
                        runs[letters] = ids
                if mark:
                    if mark not in marks:
                        if len(marks) > 4096:
                            marks.clear()
                        marks[mark] = array("I", [t.id for t in bpe(mark)]).tobytes()
                    ids += marks[mark]
                found[i] = ids
            else:
                others.append(i)
        at = 0
        for group in balanced([words[i] for i in others]):
            e = self.tokenizer.encode(" " + " ".join(group), add_special_tokens=False)
            ids, starts = array("I", e.ids).tobytes(), np.fromiter((a for a, _ in e.offsets), np.int64, len(e))
            cuts = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)).tolist()
            for a, b in zip([0, *cuts], cuts, strict=False):
                found[others[at]] = ids[4 * a : 4 * b]
                at += 1
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes)

    def _table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of known and of new words in one array, and where those of each of ``words`` start and how many they are."""
        get = self.known.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = [words[i] for i in np.nonzero(at < 0)[0].tolist()]
        ids, ends = self._words(new)
        if len(self.ids) > 1 or len(self.ends) > 1:
            self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        old = self.ends[0]
        every = np.concatenate([self.ids[0], ids])
        stops = np.concatenate([old, ends + old[-1]])
        at[at < 0] = len(old) - 1 + np.arange(len(new))
        if len(self.known) < REMEMBERED and new:
            base = len(old) - 1
            self.known.update((w, base + i) for i, w in enumerate(new) if len(w) <= WORD_CHARS)
            self.ids, self.ends = [every], [stops]
        return every, stops[at], stops[at + 1] - stops[at]

    def encode(self, texts: pa.Array, ids: bool = True) -> list:
        """For each text (null: empty) an array of its ids, or with ``ids=False`` their number."""
        texts = pc.fill_null(texts, "")
        out: list = []
        for a, b in groups(texts):
            out += self._group(texts.slice(a, b - a), ids)
        return out

    def _group(self, texts: pa.Array, ids: bool) -> list:
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        first = np.zeros(len(index), bool)
        first[offsets[:-1]] = True
        # a space beside other white space, or at an end of the text, is no safe boundary
        sizes = pc.binary_length(coded.dictionary).to_numpy()
        trimmed = pc.binary_length(pc.utf8_trim_whitespace(coded.dictionary)).to_numpy()
        bad = (sizes == 0) | (trimmed < sizes) | (sizes > CALL_BYTES)
        slow = np.add.reduceat(bad[index], offsets[:-1]) > 0
        rest = np.zeros(len(words), bool)
        rest[index[~first & ~np.repeat(slow, np.diff(offsets))]] = True
        used = np.nonzero(rest)[0]
        every, starts, sizes = self._table([words[i] for i in used.tolist()])
        place = np.zeros(len(words), np.int64)
        place[used] = np.arange(len(used))
        out: list = []
        firsts = [words[i] for i in index[offsets[:-1]].tolist()]
        for k, (word, a, b) in enumerate(zip(firsts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if slow[k]:
                found = self.whole(texts[k].as_py())
                out.append(found if ids else len(found))
                continue
            lead = self.whole(word)
            w = place[index[a + 1 : b]]
            n = sizes[w]
            if not ids:
                out.append(len(lead) + int(n.sum()))
                continue
            ends = np.cumsum(n)
            take = np.repeat(starts[w] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)
            out.append(np.concatenate([lead, every[take]]))
        return out


_encoders: dict[str, TextEncoder] = {}


def encoder(tokenizer_path: str) -> TextEncoder:
    """The worker's encoder for this tokenizer."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = TextEncoder(tokenizer_path)
    return _encoders[tokenizer_path]


def count_tokens(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """``key``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row of ``df``.

    Null and empty texts have 0 bytes and 0 tokens; a null key stays null; repeated rows are each
    counted; further columns are not read; an empty table gives an empty table. Strings of special
    tokens inside a text are read as the library reads them by default.
    """

    def make():
        encode = encoder(tokenizer_path).encode

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = pa.array(encode(batch.column("text"), ids=False), pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), n], ["key", "n_bytes", "n_tokens"])

        return each

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = map_batches(rows, make, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
