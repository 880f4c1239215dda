"""Token ids of whole texts, equal to the tokenizers library's.

A BPE tokenizer never merges across its pre-tokens, so a text is the concatenation of its pre-tokens' ids. Texts
of characters on whose class and case all versions of Unicode agree are cut into pre-tokens here and
merged by ``tiktoken``'s byte-pair core from the vocabulary in the tokenizer's own file, in one call a
text; nothing is kept from text to text. All other texts, and those with the spelling of a special
token, go to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.llm.common import map_batches, worker_state

#: Classes of characters; unusual ones are left to the library.
UNUSUAL, BLANK, LETTER, NUMBER, MARK = range(5)
#: Characters merged in one call, about; longer texts are cut at white space.
RUN = 1 << 18
#: Code points that have a class here: all planes' first, and the pictographs.
SPANS = ((0, 0xD800), (0xE000, 0x10000), (0x1F000, 0x1FB00))


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point, by its category.

    Unusual are control, format and white space characters but the four common ones, marks, what changes
    under normalisation, jamo, and letters and numbers that were none in Unicode 3.2; so is all beyond the table.
    """
    old, out = unicodedata.ucd_3_2_0, np.zeros(SPANS[-1][1] + 1, np.uint8)
    for first, end in SPANS:
        for k in range(first, end):
            c = chr(k)
            kind = unicodedata.category(c)
            if c in " \t\n\r":
                out[k] = BLANK
            elif kind[0] in "LN":
                if old.category(c) == kind and unicodedata.is_normalized("NFC", c) and not 0x1100 <= k < 0x1200:
                    out[k] = LETTER if kind[0] == "L" else NUMBER
            elif kind[0] in "PS" and unicodedata.is_normalized("NFC", c):
                out[k] = MARK
    return out


@lru_cache(maxsize=1)
def unusual() -> Callable[[str], object]:
    """Finds a character without a class."""
    edge = np.flatnonzero(np.diff((np.append(classes(), 0) != UNUSUAL).astype(np.int8), prepend=0))
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)) + "]").search


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in own)}


BYTE_LETTERS = _byte_letters()

#: Ends a pre-token of a vocabulary with word ends. No usual text holds it.
END = "\0"
#: Where a blank run leaves its last blank to what follows.
SEAM = re.compile(r"(?<=[ \t\n\r])(?=[ \t\n\r][^ \t\n\r])")
BLANKS = bytes(0x20 if b in b" \t\n\r" else b for b in range(256))
CONTRACTION = re.compile(r"'(?:[stmd]|re|ve|ll)").match


def path_of(name_or_path: str) -> str:
    """A tokenizer file: a path as given, or the place of a public file of that name."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def ended(text: str) -> str | None:
    """Pre-tokens of a lower-cased text, each with ``END`` after it: letters, single numbers, runs of other marks, contractions; blanks go. None if a character is unusual."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = classes()[np.minimum(codes, SPANS[-1][1])]
    if not kind.all():
        return None
    ends = np.empty(len(kind), bool)
    ends[:-1] = kind[1:] != kind[:-1]
    ends[-1:] = True
    ends |= kind == NUMBER
    solid = kind != BLANK
    ends &= solid
    for k in np.flatnonzero(codes == 0x27).tolist():  # a contraction begins where a run of marks would
        if (k == 0 or kind[k - 1] != MARK) and (m := CONTRACTION(text, k)):
            ends[k : m.end()] = False
            ends[m.end() - 1] = True
    places = np.cumsum(solid.astype(np.int64) + ends)
    out = np.zeros(int(places[-1]) if len(places) else 0, "<u4")
    out[(places - 1 - ends)[solid]] = codes[solid]
    return out.tobytes().decode("utf-32-le", "surrogatepass")


class TextTokenizer:
    """A tokenizers JSON file; ids equal ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, name_or_path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path_of(name_or_path))
        spec = json.loads(self.library.to_str())
        pre, normal, model = spec["pre_tokenizer"] or {}, spec["normalizer"], spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merge: Callable[[str], list[int]] | None = None
        self.ends = False
        if normal is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            # between seams no look-ahead is needed
            self.merge = self._merger(model, r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")
        elif normal is not None and model.get("end_of_word_suffix") and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed":
            self.ends = True
            self.merge = self._merger(model, f"[^{END}]+{END}")

    def _merger(self, model: dict, pattern: str) -> Callable[[str], list[int]]:
        """Byte-pair merging of whole texts by the file's own vocabulary, in which an id is a merge's rank."""
        from tiktoken import Encoding

        back, end = {v: k for k, v in BYTE_LETTERS.items()}, model.get("end_of_word_suffix") or ""
        ranks: dict[bytes, int] = {}
        for token, k in model["vocab"].items():
            body, tail = (token[: -len(end)], END.encode()) if end and token.endswith(end) else (token, b"")
            if token not in self.special and not (end and BYTE_LETTERS[0] in body):
                ranks[bytes(back[c] for c in body) + tail] = k
        if end:
            ranks[END.encode()] = max(model["vocab"].values()) + 1  # never alone: each pre-token's last byte has a form with it
        return Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.merge and not any(s in text for s in self.special):
            if self.ends:
                if "Σ" not in text:  # a capital sigma's lower case depends on its place
                    return self._each(runs(text), lambda p: ended(p.lower()))
            elif not unusual()(text):
                doubled = b"  " in text.encode("utf-8", "surrogatepass").translate(BLANKS)
                return self._each((c for r in runs(text) for c in SEAM.split(r)) if doubled else runs(text), None)
        return self._whole(text)

    def _each(self, parts: Iterable[str], change: Callable[[str], str | None] | None) -> bytes:
        out = array("I")
        for p in parts:
            if change and (q := change(p)) is None:
                out.extend(self.library.encode(p, add_special_tokens=False).ids)
            else:
                out.extend(self.merge(q if change else p))
        return out.tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


def runs(text: str, size: int = RUN) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut before a single space between other characters, where a pre-token begins in any case."""
    at = 0
    while len(text) - at > size:
        cut = LONE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


LONE = re.compile(r"(?<=[^ \t\n\r]) (?=[^ \t\n\r])")


def kept(name_or_path: str) -> tuple[tuple, Callable[[], TextTokenizer]]:
    """Key and maker of the tokenizer that a Python worker keeps over the tasks of an operator."""
    return ("tokenizer", name_or_path), lambda: TextTokenizer(name_or_path)


def tokenizer(name_or_path: str) -> TextTokenizer:
    return worker_state(*kept(name_or_path))


def tokenized(df: DataFrame, name_or_path: str, end_id: int | None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(ident, ids binary): ids of each whole text, then ``end_id``; a null text is empty. Narrow, one row a document.

    ``ids`` holds little-endian unsigned 32-bit integers.
    """
    kind = dict(df.dtypes)[ident]

    def start(tok: TextTokenizer):
        end = array("I", [] if end_id is None else [end_id]).tobytes()

        def one(b: pa.RecordBatch) -> dict:
            return {"id": b.column(0), "ids": pa.array([ids + end for ids in tok.encode_many([t or "" for t in b.column(1).to_pylist()])], pa.binary())}

        return one

    out = map_batches(df.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("t")), f"id {kind}, ids binary", start, state=kept(name_or_path))
    return out.withColumnRenamed("id", ident)


def crc32(ids: Column) -> Column:
    return F.crc32(ids)
