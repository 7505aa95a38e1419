"""Operator 2: byte-pair encoding of words by a prefix-sharing trie, and decoding.

The encoding of a word's prefix ends in one certain token, and the tokens before
it are the encoding of the rest of that prefix. So a trie over distinct words
needs one number at each node: the last token of the prefix. A token is the last
one if it ends the prefix and no merge crosses the border to the last token of
what stands before it. Words that share a prefix share its nodes.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import PIECE, by_text, pieces

#: Bytes of texts whose words are held at once: words as objects take some twenty times their bytes.
AT_ONCE = PIECE // 4
#: Encoded chunks that a worker remembers; beyond it the store starts anew.
REMEMBERED = 300_000
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?|]*")
_TAIL = b".,;:!?|"
_FAR = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _backwards(tokens: dict[bytes, int]) -> tuple[dict[int, int], array]:
    """A trie over tokens read from their last byte on: the nodes that follow (node and byte), and each node's token or -1.

    One flat dictionary; a dictionary for each node takes several times its memory.
    """
    step: dict[int, int] = {}
    token_at = array("i", [-1])
    for body, token in tokens.items():
        node = 0
        for c in reversed(body):
            edge = node << 8 | c
            node = step.get(edge, 0)
            if not node:
                node = step[edge] = len(token_at)
                token_at.append(-1)
        token_at[node] = token
    return step, token_at


class WordBPE:
    """A word-end BPE vocabulary (a ``tokenizers`` JSON file), encoded by a trie.

    Splitting text into words is left to the file's own normaliser and splitter; merging is done here.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        # The library only normalises and splits, so it gets no vocabulary.
        library = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.end: str = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.special_at = re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        byte = _byte_symbols()
        self.rank: dict[int, int] = {}  # of left and right part, in 20 bits each
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left and right part, rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault(left << 20 | right, rank)
            self.parts.setdefault(whole, (left, right, rank))
        # Bytes of each usable token, for tokens inside a word and for those that end one.
        inner: dict[bytes, int] = {}
        final: dict[bytes, int] = {}
        for token, i in vocab.items():
            ends = token.endswith(self.end) and token != self.end
            body = token[: -len(self.end)] if ends else token
            if body and all(c in byte for c in body) and (len(body) == 1 or i in self.parts):
                (final if ends else inner)[bytes(byte[c] for c in body)] = i
        self.inner_ends, self.final_ends = _backwards(inner), _backwards(final)
        self.width = array("i", [0]) * (max(vocab.values()) + 1)
        for tokens in (inner, final):
            for body, i in tokens.items():
                self.width[i] = len(body)
        names = {i: t for t, i in vocab.items()} | {i: x.decode() for x, i in self.special.items()}
        self.names = [names[i].encode() for i in range(max(names) + 1)] if len(names) == max(names) + 1 else [names.get(i, "").encode() for i in range(max(names) + 1)]
        self._joint: dict[int, bool] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}

    def _spine(self, token: int, side: int, kept: dict) -> list[tuple[int, int]]:
        """The parts at one edge of a token, smallest first, each with the rank of the merge that takes it up."""
        if token not in kept:
            out, up, t = [], _FAR, token
            while True:
                out.append((t, up))
                if t not in self.parts:
                    break
                up = self.parts[t][2]
                t = self.parts[t][side]
            kept[token] = out[::-1]
        return kept[token]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` side by side are how BPE encodes their joint text.

        Follows the parts that touch at the border as merges by ascending rank make them; of equal ranks the
        leftmost merge comes first. The pair falls if the touching parts merge before they are taken up.
        """
        left, right = self._spine(a, 1, self._right), self._spine(b, 0, self._left)
        i = j = 0
        while True:
            (x, x_up), (y, y_up) = left[i], right[j]
            m = self.rank.get(x << 20 | y)
            if m is not None and m < x_up and m <= y_up:
                apart = False
                break
            if x_up == y_up == _FAR:
                apart = True
                break
            if x_up <= y_up:
                i += 1
            else:
                j += 1
        self._joint[a << 20 | b] = apart
        return apart

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The tokens of distinct words, by a depth-first walk of their trie.

        In sorted order, the nodes on the way to a word are a stack: what it shares with the word before stays.
        """
        inner, final, width, last_of = self.inner_ends, self.final_ends, self.width, self._last
        out: dict[bytes, list[int]] = {}
        last: list[int] = [-1]  # last token of the prefix of each length
        before = b""
        for word in sorted(words):
            n, shared = len(word), 0
            most = min(n, len(before)) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for k in range(shared + 1, n):  # nodes of inner prefixes
                last.append(last_of(word, k, inner, last))
            token = last_of(word, n, final, last)
            ids, k = [token], n - width[token]
            while k:
                ids.append(last[k])
                k -= width[last[k]]
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def _last(self, word: bytes, k: int, ends: tuple[dict[int, int], array], last: list[int]) -> int:
        """The token that ends the prefix of length ``k``, the longest that stays apart from what stands before it."""
        found, start, node = [], k, 0
        step, token_at = ends
        while start:
            start -= 1
            node = step.get(node << 8 | word[start])
            if node is None:
                break
            token = token_at[node]
            if token >= 0:
                found.append((start, token))
        joint = self._joint
        while found:
            start, token = found.pop()
            if not start:
                return token
            a = last[start]
            apart = joint.get(a << 20 | token)
            if apart or apart is None and self.stay_apart(a, token):
                return token
        raise ValueError(f"no token ends {word[:k]!r}")

    def words(self, chunk: bytes) -> list[bytes | int]:
        """The words (bytes) and special tokens (ids) of a text without ASCII white space."""
        body = chunk.rstrip(_TAIL)
        if body.isalpha():  # ASCII letters
            return [body.lower(), chunk[len(body) :]]
        out: list[bytes | int] = []
        for part in self.special_at.split(chunk) if self.special_at else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                text = part.decode("utf-8", "replace")
                if _PLAIN.fullmatch(text):
                    lower = text.lower().encode()
                    word = lower.rstrip(_TAIL)
                    out += [word, lower[len(word) :]]
                else:
                    out += [bytes(_SYMBOLS[c] for c in w) for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return out

    def encode_chunks(self, chunks: Iterable[bytes], known: dict[bytes, bytes]) -> None:
        """Adds the ids of distinct chunks to ``known``, as little-endian unsigned 32-bit integers.

        Lower-case words without marks are chunks themselves, so what is known of them serves all chunks.
        """
        split = {c: self.words(c) for c in chunks}
        plain = {w for c, ws in split.items() for w in ws if w.__class__ is bytes and w not in known}
        plain.discard(b"")
        sole = {w for w in plain if _SOLE.fullmatch(w)}
        known[b""] = b""
        for some, into in ((sole, known), (plain - sole, rest := {})):
            for w, ids in self.encode_words(some).items():
                into[w] = struct.pack(f"<{len(ids)}I", *ids)
        for c, ws in split.items():
            if c not in known:
                known[c] = b"".join([(known[w] if w in known else rest[w]) if w.__class__ is bytes else struct.pack("<I", w) for w in ws])

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids, special ones too: the file names no decoder, so token texts are joined by a space."""
        return b" ".join(map(self.names.__getitem__, ids))


_SYMBOLS = _byte_symbols()
#: Words that are the same as chunks: letters that lower case leaves alone, or marks.
_SOLE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[.,;:!?|]+")


class Encoder:
    """Encodes texts and remembers the chunks (between ASCII white space) that it has met."""

    def __init__(self, bpe: WordBPE):
        self.bpe, self.known = bpe, {}

    def __call__(self, texts: list[bytes]) -> Iterator[Iterator[bytes]]:
        """The ids of each text, piece by piece; the pieces of a text must be taken before the next text."""
        start = 0
        while start < len(texts):
            end, size = start + 1, len(texts[start])
            while end < len(texts) and size + len(texts[end]) <= AT_ONCE:
                size, end = size + len(texts[end]), end + 1
            if size > AT_ONCE:
                yield (ids for piece in pieces(texts[start], AT_ONCE) for ids in self._encoded([piece]))
            else:
                yield from (iter((ids,)) for ids in self._encoded(texts[start:end]))
            start = end

    def _encoded(self, texts: list[bytes]) -> Iterator[bytes]:
        split = [t.split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*split).difference(self.known)
        if new:
            self.bpe.encode_chunks(new, self.known)
        return (b"".join(map(self.known.__getitem__, chunks)) for chunks in split)


def _encoder(path: str | None) -> Callable[[], Encoder]:
    def make() -> Encoder:
        """Made anew in each task (a third of a second), so that an idle worker holds none."""
        return Encoder(WordBPE(path or default_vocabulary()))

    return make


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), check: bool = False) -> DataFrame:
    """``ids`` (array of int) and ``n_tokens`` of every text; with ``check`` also the SHA-256 of the decoded ids.

    ``vocabulary`` is the path of a word-end BPE file; by default the public 49k one. A null text counts as
    empty and gets no ids. Texts are worked on in pieces; repeated rows repeat results; only ``keep`` and the
    text column are read.
    """

    def work(texts: list[str], encoder: Encoder) -> dict:
        ids = [np.frombuffer(b"".join(x), "<u4").astype("i4") for x in encoder([t.encode() for t in texts])]
        decoded = [hashlib.sha256(encoder.bpe.decode(x.tolist())).hexdigest() for x in ids] if check else None
        return {"n_tokens": [len(x) for x in ids], "ids": ids, "decoded_sha256": decoded}

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    more = [T.StructField("decoded_sha256", T.StringType())] if check else []
    return by_text(docs, work, fields + more, text, keep, _encoder(vocabulary), PIECE)


def decode(encoded: DataFrame, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids; null ids give null. ``decoded`` must be a new name."""
    import pyarrow as pa

    if "decoded" in encoded.columns:
        raise ValueError("encoded already has a column decoded")
    at, state = encoded.columns.index(ids), _encoder(vocabulary)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = state().bpe
        for batch in batches:
            cells = [None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield batch.append_column("decoded", pa.array(cells, pa.string()))

    return encoded.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, vocabulary: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number of tokens, SHA-256 of the ids and SHA-256 of their decoded text, for every text.

    Encodes and decodes piece by piece, so that neither ids nor decoded text of a long document are held. Null
    texts count as empty, as in ``encode``.
    """

    def work(texts: list[str], encoder: Encoder) -> dict:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for parts in encoder([t.encode() for t in texts]):
            n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
            for part in parts:
                ids.update(part)
                tokens = np.frombuffer(part, "<u4").tolist()
                if n and tokens:
                    decoded.update(b" ")
                n += len(tokens)
                decoded.update(encoder.bpe.decode(tokens))
            for name, value in zip(out, (n, ids.hexdigest(), decoded.hexdigest()), strict=True):
                out[name].append(value)
        return out

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return by_text(docs, work, fields, text, keep, _encoder(vocabulary), PIECE)
