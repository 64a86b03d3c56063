"""Token ids of whole texts by the tokenizers library, through a per-worker word cache.

The tokenizer lower-cases, then takes letter runs, single digits and mark runs apart and encodes
each by itself. For texts of ASCII and the accented Latin letters, where lower case and
composition are settled, that split is done here, so that each worker can keep the ids of the
words it has met (bounded) and ask the library's model only for new ones. Other pieces of text go
to the library as they are.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import kept

DEFAULT_TOKENIZER = "word_bpe_49k.json"

_SAFE = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*\Z")
#: The tokenizer's own split pattern, for the characters that _SAFE admits.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall
_LONG = 100


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


#: Bytes as the byte-level vocabulary writes them: visible Latin-1 as it is, others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512)))


class _Known(dict):
    """Ids of pieces, as bytes; a new piece is encoded when it is looked up. Two generations of at
    most ``most`` entries each: a full one is set aside, what is met again returns from there."""

    def __init__(self, encode, most: int):
        super().__init__()
        self._encode, self._most, self._old = encode, most, {}

    def __missing__(self, piece: str | tuple[str]) -> bytes:
        ids = self._old.get(piece)
        if ids is None:
            ids = self._encode(piece)
            if len(piece if type(piece) is str else piece[0]) > _LONG:
                return ids
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class WordIds:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, max_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        self._specials = [t.content for t in self._lib.get_added_tokens_decoder().values()]
        self._word_model = Tokenizer.from_file(path).model  # for words that are split and lower-cased already
        if hasattr(self._word_model, "_resize_cache"):
            self._word_model._resize_cache(0)  # words are kept here
        self._stored = [n.to_bytes(4, "little") for n in range(max(self._lib.get_vocab().values()) + 1)]
        self._known = _Known(self._ids, max(1, max_words // 2))

    def _pieces(self, text: str) -> list[str | tuple[str]]:
        """White-space separated pieces, lower-cased; what only the library can split is a tuple."""
        special = any(s in text for s in self._specials)
        if not special and _SAFE.match(text):
            return text.lower().split()
        out: list = []
        for piece in text.encode("utf-8", "replace").split():  # ASCII white space
            piece = piece.decode("utf-8")
            safe = _SAFE.match(piece) and not (special and any(s in piece for s in self._specials))
            out.append(piece.lower() if safe else (piece,))
        return out

    def _ids(self, piece: str | tuple[str]) -> bytes:
        if type(piece) is tuple:
            return np.array(self._lib.encode_batch_fast([piece[0]], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()
        words = [piece] if piece.isalpha() else _WORDS(piece)
        if len(words) > 1:
            return b"".join([self._known[w] for w in words])
        word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        return b"".join([self._stored[t.id] for t in self._word_model.tokenize(word)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids = self._known.__getitem__
        return [b"".join(map(ids, self._pieces(t))) if t else b"" for t in texts]


def encoder(path: str) -> WordIds:
    """This worker's encoder for a vocabulary file; kept between tasks that use tokens."""
    encoders = kept("tokens")
    if path not in encoders:
        encoders[path] = WordIds(path)
    return encoders[path]


def batches_of_texts(batch, max_chars: int = 1_000_000):
    """(first row, texts) slices of an Arrow batch's ``text`` column with bounded size."""
    texts, size, start = [], 0, 0
    for i, t in enumerate(batch.column("text").to_pylist()):
        texts.append(t)
        size += len(t) if t else 0
        if size >= max_chars:
            yield start, texts
            texts, size, start = [], 0, i + 1
    if texts:
        yield start, texts
