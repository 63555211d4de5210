"""BPE encoding and decoding by speculation and verification.

Works from a public tokenizer file (normaliser, splitter and merges of the
``tokenizers`` format with word ends). For each distinct word, greedy longest
match over the vocabulary proposes tokens. A proposal is what the merges give
if and only if every adjacent pair of its tokens survives the merges of the
pair's own text; all pairs of a batch are tested at once against a sorted table
of known pairs, and a pair is worked out exactly when first met. Only words
with a failing pair go through exact merging (linked list and heap).

White space never joins two words, so a text is encoded word by word and the
words' tokens are kept in a bounded cache. Texts are whole, each in one task,
and there is no shuffle. Null and empty texts have no tokens. Repeated rows get
equal results. Ids are those of the library, special tokens in a text included.

The tokenizer's path is a parameter; by default the file that the installed
public_tokenizers package names.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

FILE = "word_bpe_49k.json"
#: Words and pairs that one Python worker remembers before it starts afresh.
MAX_WORDS, MAX_PAIRS = 300_000, 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


class IntMap:
    """A read-only map from non-negative to non-negative integers, looked up for whole arrays (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        keys, values, slot = keys.astype(np.int64), values.astype(np.int64), self._slot(keys.astype(np.int64))
        while len(keys):
            free = self.keys[slot] < 0
            took, first = np.unique(slot[free], return_index=True)
            at = np.flatnonzero(free)[first]
            self.keys[took], self.values[took] = keys[at], values[at]
            left = np.ones(len(keys), bool)
            left[at] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is missing."""
        slot = self._slot(keys)
        out, at = self.values[slot], self.keys[slot]
        todo = np.flatnonzero((at != keys) & (at >= 0))
        out[at != keys] = -1
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
        return out


#: Words of at most so many symbols are merged as rows of a matrix, longer ones one by one.
MATRIX_LENGTH = 48
#: Longer words get no greedy proposal and go to exact merging at once.
GREEDY_LENGTH = 500
_NONE = 1 << 40


class Bpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        lib = Tokenizer.from_file(path)
        self._normal, self._split = lib.normalizer, lib.pre_tokenizer
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        if not self.end:
            raise ValueError("the file must mark word ends")
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._bytes = {i: t.encode() for i, t in self.text.items()}
        self._at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._base = max(self.text) + 2
        # single characters, within a word and at its end
        self._alphabet = max((ord(t) for t in self.vocab if len(t) == 1), default=0) + 1
        self._inner = np.full(self._alphabet + 1, -1, np.int64)
        self._final = np.full(self._alphabet + 1, -1, np.int64)
        for c in range(self._alphabet):
            self._inner[c] = self.vocab.get(chr(c), -1)
            self._final[c] = self.vocab.get(chr(c) + self.end, -1)
        # merges by pair of ids: value = rank * base + id of the merged token
        v = self.vocab
        usable = [(v[a] * self._base + v[b], r * self._base + v[a + b]) for r, (a, b) in enumerate(merges) if a in v and b in v and a + b in v]
        usable = list(dict(reversed(usable)).items())
        self._merge_map = IntMap(*(np.array(x, np.int64) for x in zip(*usable)))
        self._merge_dict = dict(usable)
        self._build_trie()
        self._spell: dict[int, tuple[int, ...]] = {}
        # a word's ids as little-endian unsigned 32-bit integers
        self._words: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._forget_pairs()

    def _codes(self, token: str) -> list[int]:
        """A token as character codes; the word end is one code."""
        if token.endswith(self.end):
            return [*map(ord, token[: -len(self.end)]), self._alphabet]
        return [*map(ord, token)]

    def _build_trie(self) -> None:
        width, edges, accept = self._alphabet + 1, {}, [-1]
        for token, i in self.vocab.items():
            node = 0
            for c in self._codes(token):
                key = node * width + c
                if (child := edges.get(key)) is None:
                    child = edges[key] = len(accept)
                    accept.append(-1)
                node = child
            accept[node] = i
        self._edges = IntMap(np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)))
        self._accept = np.array(accept, np.int64)

    # -- exact merging -----------------------------------------------------
    def _merge_long(self, sym: list[int]) -> list[int]:
        """Merges by rank, leftmost first, of one long word: linked list and heap."""
        n, base, merges = len(sym), self._base, self._merge_dict
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int, j: int) -> None:
            if (m := merges.get(sym[i] * base + sym[j])) is not None:
                heapq.heappush(heap, (m // base, i, sym[i], sym[j], m % base))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has merged meanwhile
            sym[i], sym[j], nxt[i] = merged, -1, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                offer(i, nxt[i])
            if prev[i] >= 0:
                offer(prev[i], i)
        return [x for x in sym if x >= 0]

    def merge_all(self, flat: np.ndarray, lens: np.ndarray) -> list[tuple[int, ...]]:
        """The merges of many words, given as ids of their characters one after the other."""
        first = np.concatenate(([0], np.cumsum(lens)))[:-1]
        out: list = [()] * len(lens)
        long = lens > MATRIX_LENGTH
        for w in np.flatnonzero(long).tolist():
            out[w] = tuple(self._merge_long(flat[first[w] : first[w] + lens[w]].tolist()))
        for lo, hi in ((0, 6), (6, 10), (10, 16), (16, MATRIX_LENGTH)):
            group = np.flatnonzero((lens > lo) & (lens <= hi))
            for i in range(0, len(group), 50_000):
                self._merge_rows(flat, first, lens, group[i : i + 50_000], out)
        return out

    def _merge_rows(self, flat, first, lens, group, out) -> None:
        if not len(group):
            return
        width = int(lens[group].max())
        cols = np.arange(width)
        size = lens[group].copy()
        sym = flat[np.minimum(first[group][:, None] + cols, len(flat) - 1)]
        sym[cols >= size[:, None]] = -1
        rank = np.full((len(group), width), _NONE, np.int64)

        def price(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ok = (a >= 0) & (b >= 0)
            got = np.full(len(a), -1, np.int64)
            got[ok] = self._merge_map.get(a[ok] * self._base + b[ok])
            return np.where(got >= 0, got, _NONE)

        if width > 1:
            rank[:, :-1] = price(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(group), -1)
        live = np.arange(len(group))
        while len(live):
            r = rank[live]
            at = r.argmin(axis=1)
            best = r[np.arange(len(live)), at]
            go = best < _NONE
            live, at, best = live[go], at[go], best[go]
            if not len(live):
                break
            take = np.minimum(cols + (cols > at[:, None]), width - 1)
            s = np.take_along_axis(sym[live], take, 1)
            k = np.take_along_axis(rank[live], take, 1)
            s[:, -1], k[:, -1] = -1, _NONE
            rows = np.arange(len(live))
            s[rows, at] = best % self._base
            right = np.minimum(at + 1, width - 1)
            k[rows, at] = np.where(at + 1 < width, price(s[rows, at], s[rows, right]), _NONE)
            has = at > 0
            k[rows[has], at[has] - 1] = price(s[rows[has], at[has] - 1], s[rows[has], at[has]])
            sym[live], rank[live] = s, k
            size[live] -= 1
        for w, row, n in zip(group.tolist(), sym.tolist(), size.tolist()):
            out[w] = tuple(row[:n])

    # -- speculation -------------------------------------------------------
    def propose(self, codes: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match of many words (character codes, word ends included).

        Returns the tokens, how many each word has, and whether the word is covered.
        """
        stop = np.cumsum(lens)
        at = stop - lens
        node = np.zeros(len(lens), np.int64)
        best = np.full(len(lens), -1, np.int64)
        best_at = at.copy()
        pos = at.copy()
        covered = np.ones(len(lens), bool)
        live = np.arange(len(lens))
        whose, tokens = [], []
        width = self._alphabet + 1
        while len(live):
            p = pos[live]
            more = p < stop[live]
            child = np.full(len(live), -1, np.int64)
            child[more] = self._edges.get(node[live[more]] * width + codes[p[more]])
            on = child >= 0
            w = live[on]
            node[w], pos[w] = child[on], p[on] + 1
            token = self._accept[child[on]]
            # a token that stops before the word end's code, but after the last character, is none
            fits = (token >= 0) & (pos[w] != stop[w] - 1)
            best[w[fits]], best_at[w[fits]] = token[fits], pos[w[fits]]
            w = live[~on]
            none = best[w] < 0
            covered[w[none]] = False
            done = w[~none]
            whose.append(done)
            tokens.append(best[done])
            pos[done], node[done], best[done] = best_at[done], 0, -1
            gone = np.zeros(len(live), bool)
            gone[~on] = none | (best_at[w] == stop[w])
            live = live[~gone]
        whose, tokens = np.concatenate([*whose, live]), np.concatenate([*tokens, live])  # live is empty by now
        order = np.argsort(whose, kind="stable")
        return tokens[order], np.bincount(whose, minlength=len(lens)), covered

    # -- verification ------------------------------------------------------
    def _forget_pairs(self) -> None:
        self._known, self._good = np.zeros(0, np.int64), np.zeros(0, bool)

    def _letters(self, token: int) -> tuple[int, ...]:
        """The ids of a token's single characters."""
        if (got := self._spell.get(token)) is None:
            t = self.text[token]
            ends = t.endswith(self.end)
            chars = list(t[: -len(self.end)] if ends else t)
            if ends and chars:
                chars[-1] += self.end
            got = self._spell[token] = tuple(self.vocab.get(c, -1) for c in chars)
        return got

    def _hold(self, keys: list[int]) -> list[bool]:
        """Whether two tokens in a row (or one alone) stay as they are under the merges of their own text."""
        wanted = [(a, b - 1) if b else (a,) for a, b in (divmod(k, self._base) for k in keys)]
        spelt = [tuple(chain.from_iterable(map(self._letters, w))) for w in wanted]
        lens = np.fromiter(map(len, spelt), np.int64, len(spelt))
        flat = np.fromiter(chain.from_iterable(spelt), np.int64, int(lens.sum()))
        return [m == w for m, w in zip(self.merge_all(flat, lens), wanted)]

    def _verify(self, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """For each proposal, whether all its adjacent pairs (or its only token) hold."""
        last = np.cumsum(lens) - 1
        right = np.append(flat[1:], 0) + 1
        right[last[lens == 1]] = 0
        keys = flat * self._base + right
        counts = np.ones(len(flat), bool)
        counts[last[lens > 1]] = False  # the last token is the right one of the pair before it
        keys, owner = keys[counts], np.repeat(np.arange(len(lens)), lens)[counts]
        uniq, back = np.unique(keys, return_inverse=True)
        if len(self._known) > MAX_PAIRS:
            self._forget_pairs()
        new = uniq[~np.isin(uniq, self._known, assume_unique=True)]
        if len(new):
            all_ = np.concatenate((self._known, new))
            good = np.concatenate((self._good, np.array(self._hold(new.tolist()), bool)))
            order = np.argsort(all_)
            self._known, self._good = all_[order], good[order]
        holds = self._good[np.searchsorted(self._known, uniq)][back]
        ok = np.ones(len(lens), bool)
        ok[owner[~holds]] = False
        return ok

    # -- words -------------------------------------------------------------
    def _units(self, words: list[bytes]) -> list[list[str]]:
        """Normalised and split: the units of each word that merge among themselves."""
        texts = [w.decode("utf-8", "replace") for w in words]
        joined = self._normal.normalize_str(" ".join(texts))
        parts = joined.split(" ")
        if len(parts) != len(texts) or not all(parts):  # white space beyond ASCII: one at a time
            return [[u for u, _ in self._split.pre_tokenize_str(self._normal.normalize_str(t))] for t in texts]
        found = self._split.pre_tokenize_str(joined)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        word = np.searchsorted(ends, np.fromiter((a for _, (a, _) in found), np.int64, len(found)), "right")
        out: list[list[str]] = [[] for _ in texts]
        for w, (u, _) in zip(word.tolist(), found):
            out[w].append(u)
        return out

    def _merge_units(self, units: list[str]) -> list[bytes]:
        out: list = [b""] * len(units)
        lens = np.fromiter(map(len, units), np.int64, len(units))
        cps = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        cps = np.minimum(cps, self._alphabet)
        last = np.cumsum(lens) - 1
        sym = self._inner[cps]
        sym[last] = self._final[cps[last]]
        short = lens <= GREEDY_LENGTH
        codes = np.insert(cps, last + 1, self._alphabet)[np.repeat(short, lens + 1)]
        flat, counts, covered = self.propose(codes, lens[short] + 1)
        sure = covered.copy()
        if covered.any():
            sure[covered] = self._verify(flat[np.repeat(covered, counts)], counts[covered])
        raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        for w, lo, hi, ok in zip(np.flatnonzero(short).tolist(), [0, *ends], ends, sure.tolist()):
            if ok:
                out[w] = raw[lo:hi]
        fail = ~short
        fail[short] = ~sure
        for w, ids in zip(np.flatnonzero(fail).tolist(), self.merge_all(sym[np.repeat(fail, lens)], lens[fail])):
            out[w] = np.array([i for i in ids if i >= 0], "<u4").tobytes()
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Put the tokens of new words in the cache."""
        plain = [w for w in words if not (self._at_special and b"<|" in w)]
        split = dict(zip(plain, self._units(plain))) if plain else {}
        for w in words:
            if w not in split:
                split[w] = []
                for p in self._at_special.split(w.decode("utf-8", "replace")):
                    split[w] += [int(self.special[p])] if p in self.special else self._units([p.encode()])[0] if p else []
        units = list(dict.fromkeys(u for us in split.values() for u in us if isinstance(u, str)))
        ids = dict(zip(units, self._merge_units(units))) if units else {}
        for w, us in split.items():
            self._words[w] = ids[us[0]] if len(us) == 1 and us[0] in ids else b"".join(
                ids[u] if isinstance(u, str) else u.to_bytes(4, "little") for u in us
            )

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """Bring known words into the young half of the cache; the others are returned."""
        if len(self._words) > MAX_WORDS:
            self._old, self._words = self._words, {}
        young, old, new = self._words, self._old, []
        for w in words:
            if w not in young:
                if (ids := old.get(w)) is not None:
                    young[w] = ids
                else:
                    new.append(w)
        return new

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out = []
        for lo, hi in C.chunks(texts):  # bounded, whatever the batch
            split = [t.split() for t in texts[lo:hi]]
            new = self._look_up(list(dict.fromkeys(chain.from_iterable(split))))
            for i in range(0, len(new), 20_000):
                self._learn(new[i : i + 20_000])
            get = self._words.__getitem__
            out += [b"".join(map(get, ws)) for ws in split]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The tokens' texts joined by a blank, as a file without a decoder asks for."""
        return b" ".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def tokenizer(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str | None = None, decoded: bool = True) -> DataFrame:
    """doc_id, ``ids`` (array of the text's token ids) and, if asked for, ``decoded`` (text of those ids)."""
    path = path or default_path()
    names = ["doc_id", "ids", "decoded"][: 2 + decoded]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            for lo, ids in _encoded(bpe, b.column(1)):
                columns = [b.column(0).slice(lo, len(ids)), pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32()))]
                if decoded:
                    columns.append(pa.array([bpe.decode(i).decode() for i in ids]))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return _two(docs).mapInArrow(rows, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def with_decoded(encoded: DataFrame, path: str | None = None, most: int = 1 << 18) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``, in pieces of at most ``most`` tokens (or one row)."""
    path = path or default_path()
    C.prepare(encoded.sparkSession)
    at = encoded.columns.index("ids")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            ids = b.column(at)
            sizes = ids.value_lengths().fill_null(0).to_pylist()
            lo = size = 0
            for i, n in enumerate([*sizes, most + 1]):
                if size + n > most and i > lo:
                    piece = b.slice(lo, i - lo)
                    texts = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()).decode() for x in piece.column(at).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])
                    lo, size = i, 0
                size += n

    return encoded.mapInArrow(rows, T.StructType(encoded.schema.fields + [T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, number of tokens, SHA-256 of the ids and of the decoded text: ``encode`` without its arrays."""
    path = path or default_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            for lo, ids in _encoded(bpe, b.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, len(ids)),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([sha256(i).hexdigest() for i in ids]),
                        pa.array([sha256(bpe.decode(i)).hexdigest() for i in ids]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _two(docs).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _encoded(bpe: Bpe, column: pa.Array):
    """The batch's token ids in bounded pieces, each with its first row."""
    texts = C.texts_of(column)
    for lo, hi in C.chunks(texts):
        yield lo, bpe.encode_batch(texts[lo:hi])


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))


def codec_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: doc_id, token ids and the text that they decode to, of every row."""
    C.prepare(spark)
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")
