"""Byte-pair encoding and decoding of whole texts over a trie of words.

The distinct words of a batch go into a trie.  Going down it depth first, each node gets the last token of
the encoding of its prefix: that token is the one suffix whose left neighbour, the last token of the shorter
prefix, does not merge with it.  So a shared prefix is worked out once, and the encoding of a word is read off
the path back to the root.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

# A character that no byte is shown as; stands for the end of a word.
END = "\n"
END_SUFFIX = "</w>"

_IDS = ArrayType(IntegerType())

# Words kept by one task: beyond it, the lexicon is started anew.  Bounds memory, never results.
MAX_WORDS = 150_000


def latin(pattern: str) -> str:
    """A pattern with its categories written out for the first 256 characters, where all texts are composed and
    Python's own engine is the faster one."""
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        own = "".join(f"\\x{c:02x}" for c in range(256) if regex.match(name, chr(c)))
        pattern = re.sub(r"\[[^\]]*\]", lambda m, n=name, o=own: m[0].replace(n, o), pattern)
        pattern = pattern.replace(name, f"[{own}]")
    return pattern


def byte_alphabet() -> list[str]:
    """The printable character that shows each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [shown[b] for b in range(256)]


class WordTrie:
    """Encodes words with the merges of one vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        spell = lambda t: t.removesuffix(END_SUFFIX) + END if t.endswith(END_SUFFIX) else t
        self.ids = {spell(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int, int]] = {}
        for order, (a, b) in enumerate(merges):
            left, right = self.ids[spell(a)], self.ids[spell(b)]
            whole = self.ids[spell(a + b)]
            self.rank[left, right] = order
            self.made_of.setdefault(whole, (order, left, right))
        self.widths = {i: len(t.rstrip(END)) for t, i in self.ids.items()}
        self.starts = {t[:k] for t in self.ids for k in range(1, len(t) + 1)}
        self._ends: dict[str, list[tuple[int, int]]] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    def forget(self) -> None:
        """Drop what has been worked out for pairs of tokens; it would grow with the corpus."""
        self._apart.clear()
        self._ends.clear()

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay two tokens.

        The merges that made them are undone from the last to the first; at no moment may the parts that meet
        have been merged earlier than the merge that took either away.
        """
        known = self._apart.get((left, right))
        if known is None:
            known = self._apart[left, right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        none = (-1, 0, 0)
        gone_a = gone_b = float("inf")  # when the part now meeting on either side was merged into a larger one
        while True:
            meets = self.rank.get((a, b))
            # A merge goes through a word from the left: of equal merges the left one comes first.
            if meets is not None and meets < gone_a and meets <= gone_b:
                return False
            made_a, made_b = self.made_of.get(a, none), self.made_of.get(b, none)
            if made_a[0] < 0 and made_b[0] < 0:
                return True
            if made_a[0] >= made_b[0]:
                gone_a, a = made_a[0], made_a[2]
            else:
                gone_b, b = made_b[0], made_b[1]

    def whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token."""
        known = self._whole.get(token)
        if known is None:
            made = self.made_of.get(token)
            known = made is None or (self.whole(made[1]) and self.whole(made[2]) and self._merge_wins(token))
            self._whole[token] = known
        return known

    def _merge_wins(self, token: int) -> bool:
        parts, todo = [], [token]
        while todo:
            t = todo.pop()
            made = self.made_of.get(t)
            if made is None:
                parts.append(t)
            else:
                todo += [made[2], made[1]]
        return self.merge(parts) == [token]

    def merge(self, parts: list[int]) -> list[int]:
        """Plain merging, best pair first; only for the short texts of single tokens."""
        parts = list(parts)
        pair_to = {(m[1], m[2]): t for t, m in self.made_of.items()} if not hasattr(self, "_pairs") else self._pairs
        self._pairs = pair_to
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = parts[best], parts[best + 1]
            if pair not in self.rank:
                break
            parts[best : best + 2] = [pair_to[pair]]
        return parts

    def step(self, state: str, symbol: str) -> str:
        """The longest end of what has been read that begins some token."""
        state += symbol
        while state not in self.starts:
            state = state[1:]
        return state

    def ends(self, state: str) -> list[tuple[int, int]]:
        """The tokens that a state ends in, with their numbers of symbols."""
        known = self._ends.get(state)
        if known is None:
            found = [self.ids.get(state[i:]) for i in range(len(state))]
            known = self._ends[state] = [(t, self.widths[t]) for t in found if t is not None and self.whole(t)]
        return known

    def last(self, state: str, depth: int, states: list[int]) -> int:
        """The last token of a prefix of ``depth`` symbols; ``states`` has those of all shorter ones."""
        known = self._apart
        for token, width in self._ends.get(state) or self.ends(state):
            left = states[depth - width]
            if left < 0:
                return token
            stay = known.get((left, token))
            if self.apart(left, token) if stay is None else stay:
                return token
        raise ValueError(f"no token ends {state!r}")

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Encodings of distinct words, each spelled in the byte alphabet."""
        root: dict = {}
        for word in words:
            node = root
            for c in word:
                node = node.setdefault(c, {})
            node[END] = word
        done: dict[str, list[int]] = {}
        states, starts = [-1], self.starts
        stack = [(c, child, 1, "") for c, child in root.items()]
        while stack:
            c, node, depth, state = stack.pop()
            del states[depth:]
            word = node.pop(END, None)
            if word is not None:
                done[word] = self._read(depth, self.last(self.step(state, c + END), depth, states), states)
            if node:
                state += c
                while state not in starts:
                    state = state[1:]
                states.append(self.last(state, depth, states))
                depth += 1
                stack += [(x, child, depth, state) for x, child in node.items()]
        return done

    def _read(self, depth: int, token: int, states: list[int]) -> list[int]:
        """The encoding that ends in ``token``, from the path back to the root."""
        out, widths = [], self.widths
        while token >= 0:
            out.append(token)
            depth -= widths[token]
            token = states[depth]
        return out[::-1]


class Codec:
    """Normalising, cutting into words, encoding and decoding as one vocabulary file says."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.trie = WordTrie(model["vocab"], [tuple(m) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.known_ids = pa.array(list(self.text_of), pa.int32())
        self.token_texts = pa.array(list(self.text_of.values()), pa.string())
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        parts = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.latin_words = re.compile(latin(pattern))
        self.library_cut = Split(Regex(pattern), "removed", invert=True)
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.known: set[str] = set()
        self.table = byte_alphabet()
        self.cache: dict[str | int, bytes] = {}

    def cut_words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer(text):
                cut = self.library_cut.pre_tokenize_str(self.normalizer.normalize_str(text))
                return [word for word, _ in cut]
            text = unicodedata.normalize("NFC", text)
        else:
            return self.latin_words.findall(text.lower())
        # Letter by letter: a capital sigma has no final form here.
        return self.words.findall(text.replace("Σ", "σ").lower())

    def newer(self, text: str) -> bool:
        """Whether it has characters that Python's Unicode tables lack; the library's are newer."""
        new = set(text) - self.known
        fresh = {c for c in new if unicodedata.category(c) == "Cn"}
        self.known |= new - fresh
        return bool(fresh)

    def pieces(self, text: str) -> list[str | int]:
        """Words, and ids of special tokens that are spelled out in the text."""
        if self.cut is None or "<|" not in text:
            return self.cut_words(text)
        out: list[str | int] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [self.special[part]] if i % 2 else self.cut_words(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids, the ids of all texts in one array."""
        found = [self.pieces(t) for t in texts]
        new = set(chain.from_iterable(found)) - self.cache.keys()
        if new and len(self.cache) + len(new) > MAX_WORDS:
            self.cache = {}
            self.trie.forget()
            new = set(chain.from_iterable(found))
        table = self.table
        shown = {w: "".join([table[b] for b in w.encode("utf-8", "surrogatepass")]) for w in new if isinstance(w, str)}
        codes = self.trie.encode(shown.values())
        for w in new:
            ids = codes[shown[w]] if isinstance(w, str) else [w]
            self.cache[w] = np.array(ids, np.int32).tobytes()
        get = self.cache.__getitem__
        flat = [b"".join(map(get, f)) for f in found]
        sizes = np.fromiter(map(len, flat), np.int64, len(flat)) // 4
        return np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(flat), np.int32)

    def encoded(self, texts: list[str]) -> pa.ListArray:
        offsets, ids = self.encode(texts)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens' texts with a space between them; ids outside the vocabulary have none, nor have nulls."""
        at = pc.index_in(ids.values, value_set=self.known_ids)
        if at.null_count:
            return pa.array([self._decode_one(x) for x in ids.to_pylist()], pa.string())
        offsets = ids.offsets
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, self.token_texts.take(at)), " ")
        return pc.if_else(ids.is_null(), "", texts) if ids.null_count else texts

    def _decode_one(self, ids: list[int] | None) -> str:
        return " ".join([self.text_of[i] for i in ids or [] if i in self.text_of])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


# Texts encoded, and handed on, at a time.
_AT_ONCE = 256


def _in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), _AT_ONCE):
            yield batch.slice(at, _AT_ONCE)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in new}
    return pa.RecordBatch.from_arrays([*kept.values(), *new.values()], names=[*kept, *new])


def _mapped(docs: DataFrame, step: Callable[[Codec, pa.RecordBatch], dict[str, pa.Array]], path: str, new: StructType) -> DataFrame:
    """Rows with the new columns last, in place of any of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in _in_batches(batches):
            yield _with(batch, step(own, batch))

    kept = [f for f in docs.schema.fields if f.name not in new.fieldNames()]
    return docs.mapInArrow(run, StructType([*kept, *new.fields]))


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Every row with the token ids of its whole text, ``array<int>``; a null text has none.

    ``vocabulary`` is the path of a public vocabulary file that every executor has.
    """
    new = StructType([StructField(ids_col, _IDS)])
    return _mapped(docs, lambda own, b: {ids_col: own.encoded(_texts(b[text_col]))}, vocabulary, new)


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Every row with the text of its token ids, special tokens included; null ids have the empty text."""
    new = StructType([StructField(decoded_col, StringType())])
    return _mapped(docs, lambda own, b: {decoded_col: own.decode(b[ids_col])}, vocabulary, new)


def tokenize(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Every row with its token ids and the text they decode to, in one pass without a shuffle.

    Null texts count as empty: no ids, empty decoded text.  Empty tables stay empty, repeated rows are encoded
    alike, long texts are encoded whole, other columns pass (``ids_col`` and ``decoded_col`` replace columns of
    their names).  A task keeps the encodings of at most ``MAX_WORDS`` distinct words, besides those of the
    texts at hand.
    """
    new = StructType([StructField(ids_col, _IDS), StructField(decoded_col, StringType())])

    def step(own: Codec, batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids = own.encoded(_texts(batch[text_col]))
        return {ids_col: ids, decoded_col: own.decode(ids)}

    return _mapped(docs, step, vocabulary, new)
