"""Byte-pair encoding by traversal of a trie of distinct words, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# The tokenizer's contractions, letters, single digits and runs of other characters, in ASCII.
ascii_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
# The same for Latin letters below U+0250: none of them is changed by composition, and lower case is letter by letter.
LATIN_END = "\u0250"
latin_pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+").findall
# White space as the tokenizer sees it. ``str.split`` differs only in the four separators 1C-1F.
space_free = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall
separators = re.compile("[\x1c-\x1f]").search


# Characters of the texts that share a trie. Split up they take some twelve bytes a character, beside what is remembered.
GROUP = 1 << 18
# Pairs of tokens whose standing side by side is remembered.
PAIRS = 250_000

KINDS = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


class Merges:
    """The tokens that merging can reach, and which of them may stand side by side."""

    def __init__(self, merges: Iterable[tuple[str, str]], suffix: str):
        self.suffix = suffix
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[int, str, str]] = {}
        for rank, (left, right) in enumerate(merges):
            self.rank.setdefault((left, right), rank)
            self.made.setdefault(left + right, (rank, left, right))
        self.reached = {t for t, (rank, left, right) in self.made.items() if not self._crossed(left, right, rank)}
        #: The most symbols of a token that ends in a symbol.
        self.longest: dict[str, int] = {}
        for token in self.reached:
            n = self.symbols(token)
            end = token[n - 1 :]
            self.longest[end] = max(n, self.longest.get(end, 1))
        self._apart: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> int:
        return len(token) - (len(self.suffix) if token.endswith(self.suffix) and len(token) > len(self.suffix) else 0)

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The pieces at the token's right (2) or left (1) end while it is made, each with the rank that ends it."""
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            if token not in self.made:
                return out
            ends = self.made[token][0]
            token = self.made[token][side]

    def _crossed(self, left: str, right: str, before: float) -> bool:
        """Whether merging the two side by side joins pieces across their border earlier than ``before``.

        Up to that moment each side goes its own way. Pieces x and y at the border join at their merge's rank if
        both still stand; of equal ranks the leftmost goes first, so x's own merge wins and y's loses."""
        rank = self.rank
        starts = self._spine(right, 1)
        for x, x_ends in self._spine(left, 2):
            for y, y_ends in starts:
                r = rank.get((x, y))
                if r is not None and r < before and r < x_ends and r <= y_ends:
                    return True
        return False

    def stand(self, left: str, right: str) -> bool:
        """Whether the two tokens, side by side, stay the two tokens."""
        key = (left, right)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= PAIRS:
                self._apart.clear()
            known = self._apart[key] = not self._crossed(left, right, float("inf"))
        return known

    def encode_all(self, words: Iterable[str]) -> dict[str, list[str]]:
        """The tokens of every word.

        The words make a trie whose last step carries the suffix; sorted, they are its paths depth first, so a word
        takes over the states of the prefix it shares with the one before. Each further node gets the last token of
        its prefix's encoding: the one token that ends there and may stand after the last token of the prefix
        before it. What words share is encoded once; a word's tokens are read back from its end. One word costs its
        letters times the longest token's, whatever its length."""
        out: dict[str, list[str]] = {}
        last, size = [""], [0]  # by depth, of the path walked
        reached, longest, apart, stand, suffix = self.reached, self.longest, self._apart, self.stand, self.suffix
        before = ""
        for word in sorted(words):
            n = len(word)
            shared, most = 0, min(len(before), n) - 1
            while shared < most and before[shared] == word[shared]:
                shared += 1
            before = word
            del last[shared + 1 :], size[shared + 1 :]
            for depth in range(shared + 1, n + 1):
                symbol, end = (word[depth - 1], "") if depth < n else (word[-1] + suffix, suffix)
                begin = depth - longest.get(symbol, 1)
                if begin < 0:
                    begin = 0
                while True:
                    token = word[begin:depth] + end
                    if begin == depth - 1 or token in reached:
                        if not begin:
                            break
                        key = (last[begin], token)
                        known = apart.get(key)
                        if stand(*key) if known is None else known:
                            break
                    begin += 1
                last.append(token)
                size.append(depth - begin)
            tokens, at = [], n
            while at:
                tokens.append(last[at])
                at -= size[at]
            tokens.reverse()
            out[word] = tokens
        return out


class Encoder:
    """Encodes and decodes whole texts; what it remembers of words is bounded by ``remembered`` entries."""

    def __init__(self, definition: str, remembered: int = 600_000):
        from tokenizers import Tokenizer

        stated = json.loads(definition)
        model = stated["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or stated["decoder"] or stated["post_processor"]:
            raise ValueError("a BPE tokenizer with word ends and neither decoder nor post-processor is expected")
        self.library = Tokenizer.from_str(definition)  # for Unicode normalisation and splitting only
        self.merges = Merges([tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        split = self.library.pre_tokenizer.pre_tokenize_str
        self.latin = {o: "".join(p for p, _ in split(chr(o))) for o in range(0x80, 0x250) if chr(o).isprintable()}
        self.remembered = remembered
        self.numbers = {t: str(i) for t, i in self.ids.items()}
        self.pieces: dict[str, tuple[str, str]] = {}  # ids and tokens, joined by spaces
        self.chunk_ids: dict[str, str] = {}
        self.chunk_tokens: dict[str, str] = {}
        self.blank: set[str] = set()  # chunks of no token

    def _pieces_of(self, chunk: str) -> list[str]:
        if chunk.isprintable():
            if chunk.isascii():
                return ascii_pieces(chunk.lower())
            if max(chunk) < LATIN_END:
                return [p.translate(self.latin) for p in latin_pieces(chunk.lower())]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def _learn(self, chunks: set[str]) -> None:
        pieces, numbers = self.pieces, self.numbers
        parts = {c: self._pieces_of(c) for c in chunks}
        fresh = {p for ps in parts.values() for p in ps if p not in pieces}
        for piece, tokens in self.merges.encode_all(fresh).items():
            pieces[piece] = " ".join([numbers[t] for t in tokens]), " ".join(tokens)
        for chunk, ps in parts.items():
            if len(ps) == 1:
                self.chunk_ids[chunk], self.chunk_tokens[chunk] = pieces[ps[0]]
            else:
                found = [pieces[p] for p in ps]
                self.chunk_ids[chunk] = " ".join([f[0] for f in found])
                self.chunk_tokens[chunk] = " ".join([f[1] for f in found])
                if not ps:
                    self.blank.add(chunk)

    def _forget(self) -> None:
        """Drops the older half of what is remembered."""
        for table in (self.pieces, self.chunk_ids, self.chunk_tokens):
            for key in list(islice(table, len(table) // 2 if len(table) > self.remembered // 2 else 0)):
                del table[key]
        self.blank.intersection_update(self.chunk_ids)

    def split(self, text: str | None) -> list[tuple[str | None, list[str]]]:
        """The text as special tokens and, between them, white-space-free chunks."""
        text = text or ""
        parts = self.split_special(text) if self.split_special and "<|" in text else [text]
        return [(p, []) if p in self.special else (None, space_free(p) if separators(p) else p.split()) for p in parts]

    def prepare(self, texts: list[list[tuple[str | None, list[str]]]]) -> None:
        """Encode all chunks of the split texts that are not remembered, in one trie."""
        met: set[str] = set()
        for text in texts:
            for _, chunks in text:
                met.update(chunks)
        if len(self.chunk_ids) > self.remembered:
            self._forget()
        unknown = met.difference(self.chunk_ids)
        if unknown:
            self._learn(unknown)

    def describe(self, split: list[tuple[str | None, list[str]]]) -> tuple[int, str, str]:
        """(number of tokens, ids joined by spaces, decoded text) of a prepared text: without a decoder, tokens
        are joined by spaces."""
        ids, decoded = [], []
        for special, chunks in split:
            if special:
                ids.append(str(self.special[special]))
                decoded.append(special)
                continue
            if self.blank and not self.blank.isdisjoint(chunks):
                chunks = [c for c in chunks if c not in self.blank]
            if chunks:
                ids.append(" ".join(map(self.chunk_ids.__getitem__, chunks)))
                decoded.append(" ".join(map(self.chunk_tokens.__getitem__, chunks)))
        whole = " ".join(ids)
        return (whole.count(" ") + 1 if whole else 0), whole, " ".join(decoded)

    def encode(self, text: str | None) -> list[int]:
        split = self.split(text)
        self.prepare([split])
        return [int(i) for i in self.describe(split)[1].split()]

    def decode(self, ids: Iterable[int]) -> str:
        names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        return " ".join(names[i] for i in ids)


def _described(encoder: Encoder, texts: Iterable[str | None], of) -> list:
    """``of(encoder.describe(text))`` of every text; texts share a trie in groups of about ``GROUP`` characters."""
    found, group, size = [], [], 0
    for text in texts:
        group.append(encoder.split(text))
        size += len(text or "")
        if size > GROUP:
            encoder.prepare(group)
            found += [of(encoder.describe(t)) for t in group]
            group, size = [], 0
    encoder.prepare(group)
    return found + [of(encoder.describe(t)) for t in group]


def _per_text(docs: DataFrame, definition: str, id: str, text: str, fields: str, of) -> DataFrame:
    """(id, fields): ``of(encoder.describe(text))`` for every row."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # one tokenizer's file, whatever the data's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(shared.value)
            found = _described(encoder, (t.as_py() for t in batch.column("text")), of)
            columns = [pa.array(c, KINDS[f.split()[1]]) for c, f in zip(zip(*found), fields.split(", "))]
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *[f.split()[0] for f in fields.split(", ")]])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {fields}").withColumnRenamed("id", id)


def encode(docs: DataFrame, tokenizer_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of every whole text, without special tokens added.

    Null and empty texts have no tokens. Null ids, repeated rows and other columns do not matter. The strings of
    special tokens in a text are those tokens. No rows give no rows. ``tokenizer_path`` is read by the driver."""
    return _per_text(docs, _definition(tokenizer_path), id, text, "ids array<int>", lambda d: ([int(i) for i in d[1].split()],))


def decode(encoded: DataFrame, tokenizer_path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text): the decoded text of every row's ids, special tokens included; null ids give an empty text."""
    rows = encoded.select(F.col(id).alias("id"), F.col(ids).alias("ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(_definition(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        names = {i: t for t, i in [*encoder.ids.items(), *encoder.special.items()]}
        for batch in batches:
            texts = [" ".join([names[i] for i in row.as_py() or []]) for row in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _digests(described: tuple[int, str, str]) -> tuple[int, str, str]:
    n, ids, decoded = described
    return n, _sha(ids), _sha(decoded)


def token_digests(docs: DataFrame, tokenizer_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode`` and ``decode`` give, in one pass."""
    return _per_text(docs, _definition(tokenizer_path), id, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _definition(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()
