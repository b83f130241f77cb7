"""Token ids of whole texts, word by word, with a bounded cache of words.

The word vocabulary drops white space before it merges, so the ids of a text are the ids of its words one after the
other.  Words of ASCII and Latin letters are merged from the same vocabulary by byte pairs; all others go through
the tokenizer itself.
"""

from __future__ import annotations

import functools
import json
import math
import os

import numpy as np

CACHE_WORDS = 400_000


class _Cache(dict):
    """word -> ids as little-endian uint16 bytes; missing words are encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids = self.encode(word)
        return ids


class WordBpe:
    """ids(text) of the word-end BPE vocabulary in a tokenizers file, without special tokens added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab: dict[str, int] = json.load(f)["model"]["vocab"]
        # Printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stands_for = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {}
        for token, i in vocab.items():
            body, end = (token[:-4], b"\xff") if token.endswith("</w>") and len(token) > 4 else (token, b"")
            if i < len(vocab) - 2:  # the last two are special
                ranks[bytes(stands_for[c] for c in body) + end] = i
        ranks.setdefault(b"\xff", len(vocab))  # the word end; it always merges with the byte before it
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.plain = regex.compile(r"[!-;=-~À-ÖØ-öø-įĲ-ž]+").fullmatch
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.cache = _Cache(self._word)

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if self.plain(text):
            ids = [i for piece in self.split(text.lower()) for i in self.merge(piece.encode() + b"\xff")]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u2").tobytes()

    def __call__(self, text: bytes) -> np.ndarray:
        return self.of_words(text.split())

    def of_words(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.cache.__getitem__, words)), "<u2")


class PieceBpe:
    """Pieces of a SentencePiece model with byte fallback, each word with its leading mark."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.cache = _Cache(lambda w: np.array(self.model.encode(w.decode()), "<u2").tobytes())

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.cache.__getitem__, words)), "<u2")


@functools.cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@functools.cache
def piece_bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


def entropy(ids: np.ndarray) -> float:
    """Shannon entropy in bits of the distribution of ids."""
    if not len(ids):
        return 0.0
    n = np.unique(ids, return_counts=True)[1] / len(ids)
    return max(0.0, -math.fsum((n * np.log2(n)).tolist()))
