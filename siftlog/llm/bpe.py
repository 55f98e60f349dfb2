"""Byte-pair encoding with word ends, and decoding.

A word starts as its bytes.  While any two neighbours form a known pair, the pair of lowest rank
(leftmost among equals) becomes one part.  A short word holds its parts and the ranks of its
neighbours in two contiguous lists: the lowest rank is found by a scan, the boundary is deleted
and only the two ranks beside it are looked up again.  A long word would make that quadratic, so
beyond ``SHORT`` parts a heap of candidate pairs over linked neighbours gives the same merges.

Words repeat, so each worker keeps the ids of the words it met in two tables of bounded size: when the
newer one is full it becomes the older one, and words met again move on, so frequent words always stay.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siftlog.llm.columns import field, map_batches, slices, texts_of, without

SHORT = 48  # parts; measured break-even of scan and heap
KNOWN_WORDS = 200_000  # words in each of the two tables of one worker
NO_RANK = 1 << 62

# The white space and the word pattern that the vocabulary file declares.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ("NFC", "Replace", "Lowercase")

SEPARATORS = re.compile("[\x1c-\x1f]")
PLAIN_ENDS = (",", ".", ";", ":", "!", "?")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself when printable in Latin-1, else the next letter from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def merge_by_scan(ids: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """Merge in place: parts and the ranks of neighbours as two contiguous lists."""
    rank = ranks.get
    beside = list(map(rank, zip(ids, ids[1:]), repeat(NO_RANK)))
    while beside:
        low = min(beside)
        if low == NO_RANK:
            break
        i = beside.index(low)
        ids[i] = merged[low]
        del ids[i + 1], beside[i]
        if i < len(beside):
            beside[i] = rank((ids[i], ids[i + 1]), NO_RANK)
        if i:
            beside[i - 1] = rank((ids[i - 1], ids[i]), NO_RANK)
    return ids


def merge_by_heap(ids: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """The same merges for long words, in n log n."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := ranks.get((a, b), NO_RANK)) != NO_RANK]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue  # one of the two was merged meanwhile
        ids[i], ids[j] = merged[rank], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((ids[i], ids[k]), NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (r, i, ids[i], ids[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((ids[h], ids[i]), NO_RANK)) != NO_RANK:
            heapq.heappush(heap, (r, h, ids[h], ids[i]))
    return [x for x in ids if x >= 0]


class WordTokenizer(dict):
    """Text to ids and back, for a vocabulary file of that kind; itself the newer table of known words."""

    def __init__(self, spec: bytes):
        super().__init__()
        self.older: dict[str, list[int]] = {}
        import regex

        parsed = json.loads(spec)
        model, normalizer = parsed["model"], parsed["normalizer"] or {}
        steps = tuple(x["type"] for x in normalizer.get("normalizers", ()))
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or steps != NORMALIZERS or parsed["decoder"]:
            raise ValueError("not a vocabulary of byte pairs with word ends")
        vocabulary = model["vocab"]
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = [vocabulary[c] for c in letters]
        self.last = [vocabulary[c + end] for c in letters]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocabulary[a], vocabulary[b]), rank)
            self.merged.append(vocabulary[a + b])
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.shown = {i: t for t, i in chain(vocabulary.items(), self.special.items())}
        self.word = regex.compile(WORD_PATTERN)
        self.space = re.compile(f"[{WHITE_SPACE}]+")
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def __missing__(self, piece: str) -> list[int]:
        """Ids of what stands between two spaces of a normalised text."""
        ids = self.older.get(piece)
        if ids is None:
            if piece.isalpha():
                ids = self.merged_word(piece)
            elif piece[-1:] in PLAIN_ENDS and piece[:-1].isalpha():  # most words before a comma or stop are known
                ids = self[piece[:-1]] + self[piece[-1:]]
            else:
                ids = [i for word in self.word.findall(piece) for i in self.merged_word(word)]
        if len(piece) <= 64:  # what is longer hardly repeats
            if len(self) >= KNOWN_WORDS:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merged_word(self, word: str) -> list[int]:
        data = word.encode()
        parts = list(map(self.inner.__getitem__, data))
        parts[-1] = self.last[data[-1]]
        return (merge_by_scan if len(parts) <= SHORT else merge_by_heap)(parts, self.ranks, self.merged)

    def normalised(self, text: str) -> list[str]:
        """What stands between the spaces of the text in composed form and lower case."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        # letter by letter: no rule for a sigma at a word's end
        text = text.replace("Σ", "σ").lower()
        # Python also splits at four control characters, which are no white space here
        return text.split() if not SEPARATORS.search(text) else self.space.split(text)

    def pieces(self, text: str) -> Iterator[list[int]]:
        for part in self.apart.split(text) if "<|" in text else (text,):
            if part in self.special:
                yield [self.special[part]]
            else:
                yield from map(self.__getitem__, self.normalised(part))

    def encode(self, text: str):
        import numpy as np

        return np.fromiter(chain.from_iterable(self.pieces(text)), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings joined by spaces, as the file declares no decoder; unknown ids are left out."""
        try:
            return " ".join(map(self.shown.__getitem__, ids))
        except KeyError:
            return " ".join(self.shown[i] for i in ids if i in self.shown)


_loaded: dict[str, WordTokenizer] = {}


def loaded(spec: bytes) -> WordTokenizer:
    key = hashlib.sha256(spec).hexdigest()
    if key not in _loaded:
        _loaded[key] = WordTokenizer(spec)
    return _loaded[key]


def _spec(df: DataFrame, path: str):
    with open(path, "rb") as f:  # a file of the tokenizer, at most a few MB
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, out: str = "ids") -> DataFrame:
    """Add ``out``, the ids (array<int>) of every whole text, by the vocabulary file at ``path``.

    Null and empty texts have no ids.  ``keep`` names the columns that stay (default: all); an input
    column called ``out`` is replaced.  Row count and row order within a partition stay.
    """
    spec = _spec(df, path)
    kept = without(df.columns if keep is None else keep, [out])
    schema = T.StructType([*(field(df, c) for c in kept), T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    width = len(kept)

    def make(batches):
        import numpy as np
        import pyarrow as pa

        tokenizer = loaded(spec.value)
        for batch in batches:
            for part in slices(batch, width):
                found = [tokenizer.encode(t) for t in texts_of(part.column(width))]
                ends = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=ends[1:])
                flat = pa.array(np.concatenate(found), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], lists], names=schema.names)

    return map_batches(df.select(*(df[c] for c in kept), df[text].alias("__text")), make, schema)


def id_lists(column) -> Iterator[list[int] | None]:
    """Arrow lists of ids as Python lists, made from one flat list; a null id becomes -1, which no vocabulary has."""
    import numpy as np
    import pyarrow.compute as pc

    flat = np.asarray(pc.fill_null(column.flatten(), -1)).tolist()
    at = 0
    for length in column.value_lengths().to_pylist():
        yield None if length is None else flat[at:at + length]
        at += length or 0


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None, out: str = "decoded") -> DataFrame:
    """Add ``out``, the text of the ids in column ``ids``; null ids give null, no ids an empty text."""
    spec = _spec(df, path)
    kept = without(df.columns if keep is None else keep, [out])
    schema = T.StructType([*(field(df, c) for c in kept), T.StructField(out, T.StringType())])
    width = len(kept)

    def make(batches):
        import pyarrow as pa

        tokenizer = loaded(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if x is None else tokenizer.decode(x) for x in id_lists(part.column(width))]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(texts, pa.string())], names=schema.names)

    return map_batches(df.select(*(df[c] for c in kept), df[ids].alias("__ids")), make, schema)
