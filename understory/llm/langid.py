"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's likelihood is the sum over
all its segmentations into pieces, by the forward algorithm, rescaled on the way so that words of any length
have one; a text's is the product over its words. The probabilities come from expectation maximisation
(forward-backward) on word counts of labelled texts, its expectations taken on the executors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.llm.common import discard, enter, map_batches, stored
from understory.llm.tokens import path_of

VOCABULARY = "piece_bpe_32k.model"
#: Labelled texts per language that a fit reads, about; and the longest run of letters that it takes for a word.
FIT_TEXTS = 400
FIT_LETTERS = 1024
ROUNDS = 3
#: Tasks of a fit, and words of a language that one works on at once.
FIT_TASKS = 8
FIT_WORK = 1 << 14
#: Pseudo-count of each piece; share of probability kept for letters outside the vocabulary.
SMOOTH = 0.01
STRAY = 1e-6
#: Words whose likelihoods a worker keeps, and the longest of them.
CACHE_WORDS = 60_000
CACHE_LETTERS = 32
#: Letters of a long word in work at once; characters of a long text.
SEGMENT = 4096
RUN = 1 << 18
#: Log odds are divided by this before they become a score, since words aren't independent.
TEMPERATURE = 4.0
UNKNOWN = "und"

words_of = re.compile(r"[^\W\d_]+").findall
gap_from = re.compile(r"[\W\d_]").search


@lru_cache(maxsize=4)
def vocabulary(name_or_path: str) -> tuple[str, ...]:
    """The lower-cased letter pieces of the public vocabulary, in its order. A space mark before a piece is dropped: a word starts anyway."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path_of(name_or_path))
    found = (m.id_to_piece(k).lstrip("▁").lower() for k in range(m.vocab_size()) if not (m.is_byte(k) or m.is_control(k) or m.is_unknown(k)))
    return tuple(dict.fromkeys(p for p in found if p and p.isalpha()))


class Trie:
    """Prefixes of the pieces, followed for whole arrays: (prefix, letter) -> longer prefix, by open addressing."""

    MIX, BITS = np.uint64(0x9E3779B97F4A7C15), 18

    def __init__(self, pieces: tuple[str, ...]):
        self.none, self.longest = len(pieces), max(map(len, pieces), default=1)
        number = {p: k for k, p in enumerate(pieces)}
        nodes = {"": 0} | {p: k + 1 for k, p in enumerate(sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)}))}
        #: The piece that each prefix is, or "none".
        self.piece = np.array([number.get(p, self.none) for p in nodes], np.int32)
        steps = [(nodes[p[:-1]], ord(p[-1]), k) for p, k in nodes.items() if p]
        size = 1 << max(self.BITS, len(steps).bit_length() + 2)
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.slots, self.child = np.full(size, 1 << 63, np.uint64), np.full(size, -1, np.int32)
        node, letter, child = (np.array(x, np.int64) for x in zip(*steps, strict=True)) if steps else (np.empty(0, np.int64),) * 3
        key = self._key(node, letter.astype(np.uint32))
        at, todo, self.probes = self._first(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            free = self.slots[at[todo]] == 1 << 63
            spots, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.slots[spots], self.child[spots] = key[won], child[won]
            todo = np.setdiff1d(todo, won)
            at[todo] = (at[todo] + 1) % size

    def _key(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        return (node.astype(np.uint64) << np.uint64(21)) | letter.astype(np.uint64)

    def _first(self, key: np.ndarray) -> np.ndarray:
        return ((key * self.MIX) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The longer prefixes, -1 for none."""
        key = self._key(node, letter)
        at, out = self._first(key), np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        for _ in range(self.probes):
            found = self.slots[at] == key
            out[left[found]] = self.child[at[found]]
            on = ~found & (self.slots[at] != 1 << 63)
            if not on.any():
                break
            left, key, at = left[on], key[on], (at[on] + 1) % len(self.slots)
        return out


@lru_cache(maxsize=4)
def trie(name_or_path: str) -> Trie:
    return Trie(vocabulary(name_or_path))


class Lattice:
    """Pieces in equally long words: at[l - 1, i, w] is the number of the piece of l letters from letter i of word w, or "none", or, for one letter, "stray letter"."""

    def __init__(self, t: Trie, words: list[str]):
        self.n, self.w, self.none, self.longest = len(words[0]), len(words), t.none, t.longest
        letters = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, self.n).T).reshape(-1)
        self.at = np.full((min(t.longest, self.n), self.n, self.w), t.none, np.int32)
        here, node = np.arange(len(letters)), np.zeros(len(letters), np.int32)
        for l in range(1, len(self.at) + 1):
            inside = here < (self.n - l + 1) * self.w
            here, node = here[inside], node[inside]
            node = t.step(node, letters[here + (l - 1) * self.w])
            here, node = here[node >= 0], node[node >= 0]
            if not len(here):
                break
            self.at[l - 1].reshape(-1)[here] = t.piece[node]
        one = self.at[0]
        one[one == t.none] = t.none + 1
        #: Lengths of the pieces from each letter of any word.
        some = (self.at != t.none).any(axis=2)
        self.lengths = [(np.flatnonzero(some[:, i]) + 1).tolist() for i in range(self.n)]
        self.ending: list[list[int]] = [[] for _ in range(self.n + 1)]
        for i, found in enumerate(self.lengths):
            for l in found:
                self.ending[i + l].append(l)

    def _add(self, to: np.ndarray, of: np.ndarray, k: np.ndarray, p: np.ndarray, l: int) -> None:
        if l == 1:
            to += of * p[k]
        else:
            w = np.flatnonzero(k != self.none)
            to[w] += of[w] * p[k[w]]

    def _rescale(self, rows: np.ndarray, scale: np.ndarray) -> None:
        """Bring the rows that are still needed, which are of one scale, near one."""
        m = rows.max(axis=0)
        rows /= m
        scale += np.log(m)

    def forward(self, p: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the segmentations of each prefix, (n + 1, words, ...), and logs of their scales. p: (pieces + 2, ...).

        ``first`` gives the first rows where a word goes on from letters before.
        """
        a = np.zeros((self.n + 1, self.w, *p.shape[1:]))
        s = np.zeros_like(a)
        known = 1 if first is None else len(first)
        a[:known] = 1 if first is None else first
        for j in range(known, self.n + 1):
            for l in self.ending[j]:
                self._add(a[j], a[j - l], self.at[l - 1, j - l], p, l)
            if j % self.longest == 0:
                scale = s[j].copy()
                self._rescale(a[max(0, j - self.longest + 1) : j + 1], scale)
                s[max(0, j - self.longest + 1) :] = scale
        return a, s

    def backward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of each suffix."""
        b = np.zeros((self.n + 1, self.w, *p.shape[1:]))
        t = np.zeros_like(b)
        b[self.n] = 1
        for i in range(self.n - 1, -1, -1):
            for l in self.lengths[i]:
                self._add(b[i], b[i + l], self.at[l - 1, i], p, l)
            if (self.n - i) % self.longest == 0:
                scale = t[i].copy()
                self._rescale(b[i : i + self.longest], scale)
                t[: i + self.longest] = scale
        return b, t

    def logs(self, p: np.ndarray) -> np.ndarray:
        """Log likelihood of each word, (words, ...)."""
        a, s = self.forward(p)
        return np.log(a[self.n]) + s[self.n]

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts under one language's p, words counted by their weights."""
        (a, s), (b, t) = self.forward(p), self.backward(p)
        whole = np.log(a[self.n]) + s[self.n]
        ks, cs = [], []
        for i, found in enumerate(self.lengths):
            for l in found:
                k = self.at[l - 1, i]
                w = np.flatnonzero(k != self.none)
                with np.errstate(divide="ignore"):
                    logs = np.log(a[i, w]) + np.log(b[i + l, w]) + (s[i, w] + t[i + l, w] - whole[w])
                ks.append(k[w])
                cs.append(weight[w] * p[k[w]] * np.exp(np.minimum(logs, 700)))
        return np.bincount(np.concatenate(ks), np.concatenate(cs), len(p))


@dataclass
class Model:
    languages: list[str]
    #: (pieces + 2, languages); the last two rows are "none" and "stray letter".
    p: np.ndarray
    name: str = VOCABULARY


def _lattices(t: Trie, words: list[str], most: int = 1 << 16) -> Iterator[tuple[list[int], Lattice]]:
    """Lattices of equally long words, of about ``most`` letters each, with the words' places."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for n, ks in by.items():
        step = max(1, most // n)
        for at in range(0, len(ks), step):
            some = ks[at : at + step]
            yield some, Lattice(t, [words[k] for k in some])


def start(pieces: int) -> np.ndarray:
    """Probabilities before the first round: all pieces alike."""
    p = np.full(pieces + 2, 1.0 / max(pieces, 1))
    p[-2], p[-1] = 0, STRAY
    return p


def maximised(counts: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts."""
    c = counts + SMOOTH
    c[-2:] = 0
    p = c / c.sum() * (1 - STRAY)
    p[-2], p[-1] = 0, STRAY
    return p


def expectations(t: Trie, words: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p))
    for ks, x in _lattices(t, words):
        out += x.expected(p, weight[ks])
    return out


def fit(words: dict[str, dict[str, float]], name_or_path: str = VOCABULARY, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language from its words' counts, here."""
    t, languages = trie(name_or_path), sorted(words)
    out = np.zeros((t.none + 2, len(languages)))
    for k, lang in enumerate(languages):
        own, weight, p = list(words[lang]), np.array(list(words[lang].values()), float), start(t.none)
        for _ in range(rounds):
            p = maximised(expectations(t, own, weight, p))
        out[:, k] = p
    return Model(languages, out, name_or_path)


def training_words(labelled: DataFrame, lang: str = "lang", text: str = "text", ident: str = "doc_id", texts: int = FIT_TEXTS, letters: int = FIT_LETTERS) -> DataFrame:
    """(lang, w, n): all words of a bounded sample of each language's texts, counted.

    The sample is by a hash of the id, at a rate that takes about ``texts`` whole texts of each language. Runs of more than
    ``letters`` letters are no words to learn from.
    """
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}  # a row a language
    known = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1 << 20, -(-texts * (1 << 20) // n))))]) if sizes else None
    rate = F.element_at(known, F.col(lang)) if sizes else F.lit(0)
    some = labelled.where(F.pmod(F.xxhash64(F.col(ident), F.lit(7)), F.lit(1 << 20)) < rate)
    found = some.select(F.col(lang).alias("lang"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"))
    return found.where(F.length("w") <= letters).groupBy("lang", "w").agg(F.count("*").alias("n"))


def fitted_on(counts: DataFrame, name_or_path: str = VOCABULARY, rounds: int = ROUNDS, tasks: int = FIT_TASKS) -> Model:
    """A model from word counts (lang, w, n). Each round is one job over them: a task returns one vector a language."""
    spark = counts.sparkSession
    own = stored(counts, "words")
    languages = sorted(r.lang for r in own.select("lang").distinct().collect())
    t = trie(name_or_path)
    p = np.stack([start(t.none)] * len(languages), axis=1) if languages else np.zeros((t.none + 2, 0))
    for _ in range(rounds if languages else 0):
        sent = spark.sparkContext.broadcast((languages, p))  # bounded: vocabulary x languages

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            enter()
            known, now = sent.value
            out = {k: np.zeros(len(now)) for k in known}
            held: dict[str, tuple[list[str], list[float]]] = {k: ([], []) for k in known}

            def take(least: int) -> None:
                """Words in work at once, so that lattices of one length hold many."""
                for k, of in enumerate(known):
                    words, n = held[of]
                    if len(words) > least:
                        out[of] += expectations(trie(name_or_path), words, np.array(n, float), now[:, k])
                        held[of] = [], []

            for b in batches:
                for lang, w, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    if re.fullmatch(r"[^\W\d_]+", w):
                        held[lang][0].append(w)
                        held[lang][1].append(n)
                take(FIT_WORK)
            take(0)
            yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array([v.tobytes() for v in out.values()], pa.binary())], ["lang", "counts"])

        total = {k: np.zeros(t.none + 2) for k in languages}
        for r in own.select("lang", "w", "n").repartition(tasks).mapInArrow(run, "lang string, counts binary").collect():
            total[r.lang] += np.frombuffer(r.counts)
        p = np.stack([maximised(total[k]) for k in languages], axis=1)
        sent.unpersist()
    discard(own)
    return Model(languages, p, name_or_path)


class Scorer:
    """Log likelihoods of words under each language; those of short words are kept in a bounded cache."""

    def __init__(self, model: Model):
        self.model, self.trie = model, trie(model.name)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.empty((CACHE_WORDS, len(self.model.languages)))

    def logs(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.model.languages)))
        short = [k for k, w in enumerate(words) if len(w) <= SEGMENT]
        for ks, x in _lattices(self.trie, [words[k] for k in short]):
            out[[short[k] for k in ks]] = x.logs(self.model.p)
        for k in set(range(len(words))).difference(short):
            out[k] = self._long(words[k])
        return out

    def _long(self, word: str) -> np.ndarray:
        """A long word in segments; each goes on from the last sums of the one before."""
        rows, scale, back = np.ones((1, 1, len(self.model.languages))), 0.0, self.trie.longest - 1
        for at in range(0, len(word), SEGMENT):
            x = Lattice(self.trie, [word[at - len(rows) + 1 : at + SEGMENT]])
            a, s = x.forward(self.model.p, rows)
            rows = a[max(0, len(a) - back - 1) :]
            scale = scale + s[-1, 0]
        return np.log(rows[-1, 0]) + scale

    def _take(self, lists: list[list[str]]) -> np.ndarray:
        """Summed log likelihoods of the words of each list."""
        distinct = set().union(*lists)
        if missing := [w for w in distinct.difference(self.known) if len(w) <= CACHE_LETTERS]:
            if len(self.known) + len(missing) > CACHE_WORDS:
                self._clear()
                missing = [w for w in distinct if len(w) <= CACHE_LETTERS]
            if len(missing) > len(self.rows):
                self.rows = np.empty((len(missing), self.rows.shape[1]))
            first = len(self.known)
            self.rows[first : first + len(missing)] = self.logs(missing)
            self.known.update(zip(missing, range(first, first + len(missing)), strict=True))
        out = np.zeros((len(lists), self.rows.shape[1]))
        long = [w for w in distinct if len(w) > CACHE_LETTERS]
        apart = dict(zip(long, self.logs(long), strict=True)) if long else {}
        for k, words in enumerate(lists):
            if apart:
                for w in words:
                    if w in apart:
                        out[k] += apart[w]
                words = [w for w in words if w not in apart]
            out[k] += self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
        return out

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: ``und`` and 0 without letters or languages; a score lies between 0 and 1."""
        total, some = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), bool)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in runs((text or "").lower()):
                if words := words_of(part):
                    held.append((k, words))
                    some[k] = True
                    size += len(part)
                if held and size >= RUN:
                    np.add.at(total, [h[0] for h in held], self._take([h[1] for h in held]))
                    held, size = [], 0
        if held:
            np.add.at(total, [h[0] for h in held], self._take([h[1] for h in held]))
        return [self._chosen(x) if ok and len(x) else (UNKNOWN, 0.0) for x, ok in zip(total, some, strict=True)]

    def _chosen(self, total: np.ndarray) -> tuple[str, float]:
        p = np.exp((total - total.max()) / TEMPERATURE)
        best = int(p.argmax())
        return self.model.languages[best], float(p[best] / p.sum())


def runs(text: str, size: int = RUN) -> Iterable[str]:
    """The text in parts of about ``size`` characters, cut where no word is."""
    at = 0
    while len(text) - at > size and (cut := gap_from(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def predicted(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(ident, lang_pred, score, carried columns) of each whole text, in one narrow pass; only the text is an input.

    ``und`` with score 0 for null texts, texts without letters, and a model without languages.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.p, model.name))  # bounded: vocabulary x languages
    mark = uuid.uuid4().hex
    kinds = dict(docs.dtypes)
    own = [F.col(ident).alias("id"), F.col(text).cast("string").alias("t"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]]
    schema = f"id {kinds[ident]}, lang_pred string, score double" + "".join(f", c{k} {kinds[c]}" for k, c in enumerate(carry))

    def begin(scorer: Scorer):
        def one(b: pa.RecordBatch) -> dict:
            got = scorer.scores(b.column(1).to_pylist())
            return {"id": b.column(0), "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())} | {f"c{k}": b.column(2 + k) for k in range(len(carry))}

        return one

    out = map_batches(docs.select(*own), schema, begin, state=(("scorer", mark), lambda: Scorer(Model(*sent.value)))).withColumnRenamed("id", ident)
    for k, c in enumerate(carry):
        out = out.withColumnRenamed(f"c{k}", c)
    return out


def held_out(ident: str = "doc_id"):
    """The test fold: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, name_or_path: str = VOCABULARY) -> Model:
    """A model from the labelled texts outside the test fold."""
    labelled = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return fitted_on(training_words(labelled), name_or_path)
