"""Packing by power-of-two decomposition.

A document's tokens (with one closing id) are cut into pieces of the lengths in the binary
form of their number, 4096 at most: the longest first. Each piece is a sequence of its
own, so no sequence crosses documents, none needs padding, and a training batch is drawn
from one bucket of equal lengths (``bucket`` = log2 of the length).

Tokens come from the tokenizers library. The vocabulary's pre-tokenizer never lets a token
span ASCII white space, so each worker encodes a distinct word once (a bounded cache) and
a text's ids are those of its words in order. A text that holds one of the vocabulary's
special strings goes to the library whole.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed each;
very long texts make many full pieces.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfew.llm.common import append_arrow, table
from lumenfew.llm.textvec import words_of

LONGEST = 4096
CLOSE = 2
VOCABULARY = "word_bpe_49k.json"
#: Words that a worker remembers.
CACHE = 700_000
#: Characters beyond printable ASCII and Latin, whose normal form may have another length.
_ODD = re.compile("[^ -~\xa1-\u017f]|\u0130")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts, by distinct words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism here
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Bytes of each token: byte-level vocabularies have one character a byte.
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token.removesuffix("</w>"))
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.size, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def remember(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.known)
        while n + len(words) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.begin[n : n + len(words)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(words)] = size
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def learn(self, words: list[bytes]) -> None:
        """Have the library encode new words, many in one text; where a word's ids end follows from the tokens' bytes."""
        text = b" ".join(words).decode()
        if _ODD.search(text) or any(s in text for s in self.specials):
            odd = [bool(_ODD.search(w)) or any(s in w for s in self.specials) for w in text.split(" ")]
            for w, o in zip(words, odd, strict=True):
                if o:
                    ids = self.whole(w.decode())
                    self.remember([w], ids, np.array([len(ids)]))
            words = [w for w, o in zip(words, odd, strict=True) if not o]
            text = b" ".join(words).decode()
        if words:
            parts = text.split(" ")
            made = self.tokenizer.encode_batch_fast([" ".join(parts[i : i + 1000]) for i in range(0, len(parts), 1000)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in made])
            space = np.flatnonzero(np.frombuffer((text.lower() + " ").encode(), np.uint8) == 32)
            end = np.searchsorted(np.cumsum(self.token_bytes[ids]), space - np.arange(len(space))) + 1
            self.remember(words, ids, np.diff(end, prepend=0))

    def batch(self, column: pa.Array, close: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the closing id, one after another; where each text's begin, and the end."""
        # only ASCII white space may part words here: what else counts as white space stays inside
        words = words_of(column)
        n_docs, n_words = len(column), len(words.start)
        _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        raw = words.data.tobytes()
        distinct = [raw[i:j] for i, j in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
        missing = [w for w in distinct if w not in self.known]
        if len(self.known) + len(missing) > CACHE:
            self.reset()
            missing = distinct
        if not self.known:
            self.remember([b""], np.array([close], np.uint32), np.array([1]))  # no word is empty
        if missing:
            self.learn(missing)
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        # each text's words, then the closing id, as places in the cache
        order = np.full(n_words + n_docs, self.known[b""])
        order[np.arange(n_words) + words.doc] = place[which]
        ends = words.first[1:] + np.arange(n_docs) + 1
        run = self.size[order]
        upto = np.cumsum(run)
        made = self.flat[np.arange(run.sum()) + np.repeat(self.begin[order] - upto + run, run)]
        bounds = np.concatenate([[0], upto[ends - 1]]) if n_docs else np.zeros(1, np.int64)
        if any(s.encode() in raw for s in self.specials):
            texts = [made[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            for i, t in enumerate(column.to_pylist()):
                if t and any(s in t for s in self.specials):
                    texts[i] = np.append(self.whole(t), np.uint32(close))
            made, bounds = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        return made.astype("<u4"), bounds


def binary_cuts(n: int, longest: int = LONGEST) -> list[int]:
    """The piece lengths of ``n`` tokens: as many of ``longest`` as fit, then the binary form of the rest."""
    return [longest] * (n // longest) + [1 << i for i in reversed(range(longest.bit_length() - 1)) if n % longest >> i & 1]


def pieces(docs: DataFrame, path: str | None = None, longest: int = LONGEST, close: int = CLOSE, keep: list[str] | None = None) -> DataFrame:
    """One row a piece: the kept columns, ``start, length, ids`` (binary, little-endian uint32), ``doc_tokens``, ``sequence_id``, ``offset``, ``bucket``."""
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = path or vocabulary_path()
    state: dict[str, Encoder] = {}

    def encode(column):
        if path not in state:
            state[path] = Encoder(path)
        ids, bounds = state[path].batch(column, close)
        cuts = [binary_cuts(n, longest) for n in np.diff(bounds).tolist()]
        length = np.array([c for own in cuts for c in own], np.int64)
        each = np.array([len(own) for own in cuts])
        at = np.concatenate([[0], np.cumsum(length)])
        start = at[:-1] - np.repeat(bounds[:-1], each)
        content = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(4 * at), pa.py_buffer(ids)]).cast(pa.binary())
        own = pa.StructArray.from_arrays([pa.array(start), pa.array(length), content], names=["start", "length", "ids"])
        return (pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), own),)

    names = [c for c in (docs.columns if keep is None else keep) if c not in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket")]
    found = append_arrow(docs, "text", [("__pieces", "array<struct<start:bigint,length:bigint,ids:binary>>")], encode, names)
    last = F.element_at("__pieces", -1)
    own = [F.col(f"`{c}`") for c in names]
    flat = found.select(*own, (last["start"] + last["length"]).alias("doc_tokens"), F.explode("__pieces").alias("p"))
    bucket = F.log2(F.col("p.length").cast("double")).cast("int")
    return flat.select(*own, "p.start", "p.length", "p.ids", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), bucket.alias("bucket"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies."""
    found = pieces(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
