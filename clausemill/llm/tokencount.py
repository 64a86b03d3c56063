"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary file.

Two deterministic transducers do the work; neither emits tokens, only counts of them.

* The splitter reads classes of code points and marks where pieces of text begin. What a chunk of
  text does to the state is a map from states to states; all maps that can come up are numbered,
  so that composing two is one lookup. Chunks are read side by side, a parallel prefix scan over
  their maps gives the state each begins in, and a second reading marks the pieces.
* The counter reads a piece's bytes. Its transitions carry how many tokens more (or fewer) the
  prefix read so far has than the one before. Its states are what later bytes can tell apart: the
  suffixes that may still grow into a token, with the token before each and the tokens since. They
  are built when first reached and forgotten when there are too many. All pieces of a batch are
  read side by side.

Both are exact: the last token of a prefix is the longest vocabulary entry that ends there and
that byte-pair merging would not join with the token before it, and only one does.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, tidy

DEFAULT_TOKENIZER = "byte_bpe_50k.json"

#: Classes of code points: letters that may end a contraction apart, other letters, numbers,
#: the space, other white space, the apostrophe, all else, and the end of a segment.
_STMD, _R, _V, _LL, _E, _LETTER, _NUMBER, _SPACE, _BLANK, _APOSTROPHE, _OTHER, _END = range(12)
_LETTERS = (_STMD, _R, _V, _LL, _E, _LETTER)
_UNKNOWN = 255
#: States: at a piece's first place, in letters, numbers or other characters, after one space or
#: blank, after several that end in a space or blank, after a leading apostrophe and after its r or v, or l.
_FRESH, _IN_L, _IN_N, _IN_O, _SP1, _BL1, _SPN, _BLN, _APO, _APO_E, _APO_L = range(11)
_BEFORE, _EARLIER = 1, 2  # a piece begins at this character, at the one before it


def _step(state: int, c: int) -> tuple[int, int]:
    """The splitter's next state and mark for a class: the rules of the split pattern."""
    begun = {_NUMBER: _IN_N, _SPACE: _SP1, _BLANK: _BL1, _APOSTROPHE: _APO, _OTHER: _IN_O, _END: _FRESH}.get(c, _IN_L)
    run = {_NUMBER: _IN_N, _APOSTROPHE: _IN_O, _OTHER: _IN_O}.get(c, _IN_L)  # what a space before it may join
    white = {_SPACE: _SPN, _BLANK: _BLN}.get(c)
    if c == _END:
        return _FRESH, _BEFORE | (_EARLIER if state in (_APO_E, _APO_L) else 0)
    if state == _FRESH:
        return begun, _BEFORE
    if state in (_IN_L, _IN_N, _IN_O):
        same = {_IN_L: c in _LETTERS, _IN_N: c == _NUMBER, _IN_O: c in (_OTHER, _APOSTROPHE)}[state]
        return (state, 0) if same else (begun, _BEFORE)
    if state in (_SP1, _BL1, _SPN, _BLN):
        if white is not None:
            return white, 0
        if state == _SP1:
            return run, 0
        if state == _SPN:
            return run, _EARLIER
        return begun, _BEFORE | (_EARLIER if state == _BLN else 0)
    if state == _APO:
        if c == _STMD:
            return _FRESH, 0
        if c in (_R, _V, _LL):
            return (_APO_L if c == _LL else _APO_E), 0
        return (_IN_O, 0) if c in (_OTHER, _APOSTROPHE) else (begun, _BEFORE)
    if c == (_E if state == _APO_E else _LL):
        return _FRESH, 0
    return (_IN_L, _EARLIER) if c in _LETTERS else (begun, _BEFORE | _EARLIER)  # no contraction: a letter run since the letter


class Splitter:
    """Where the pieces of texts begin; classes of code points are asked of the library once each."""

    def __init__(self, pre_tokenize, width: int = 128):
        self._ask, self.width = pre_tokenize, width
        n_states, n_classes = 11, 12
        step = np.array([[_step(s, c) for c in range(n_classes)] for s in range(n_states)], np.uint8)
        self._next = np.ascontiguousarray(step[:, :, 0]).ravel().astype(np.intp)
        self._mark = np.ascontiguousarray(step[:, :, 1]).ravel()
        self._n = n_classes
        self._number_maps([tuple(int(x) for x in step[:, c, 0]) for c in range(n_classes)], n_states)
        self._class = np.full(0x110001, _UNKNOWN, np.uint8)
        self._class[0x110000] = _END
        self._learn(np.arange(128))
        for letters, c in (("stmd", _STMD), ("r", _R), ("v", _V), ("l", _LL), ("e", _E), ("'", _APOSTROPHE), (" ", _SPACE)):
            self._class[[ord(x) for x in letters]] = c

    def _number_maps(self, one: list[tuple], n_states: int) -> None:
        """All maps that sequences of classes make, and the tables that compose them."""
        maps = {tuple(range(n_states)): 0}
        todo = list(maps)
        for m in todo:  # grows
            for c in one:
                new = tuple(c[s] for s in m)
                if new not in maps:
                    maps[new] = len(maps)
                    todo.append(new)
        self.maps = np.array(todo, np.intp)
        self._after = np.array([[maps[tuple(c[s] for s in m)] for c in one] for m in todo], np.intp).ravel()
        code = np.array([n_states**i for i in range(n_states)], np.int64)
        keys = self.maps @ code
        order = np.argsort(keys)
        both = np.stack([self.maps[:, m] @ code for m in self.maps])
        self._compose = order[np.searchsorted(keys[order], both)].astype(np.intp)  # [first, then]

    def _learn(self, points: np.ndarray) -> None:
        for p in points.tolist():
            c = chr(p)
            at = [s for _, (s, _) in self._ask(f"a{c}1")]
            if 1 not in at:
                kind = _LETTER
            elif 2 not in at:
                kind = _NUMBER
            else:
                kind = _OTHER if len(self._ask(f"!{c}!")) == 1 else _BLANK
            self._class[p] = kind

    def classes(self, points: np.ndarray) -> np.ndarray:
        c = self._class[points]
        if (c == _UNKNOWN).any():
            self._learn(np.unique(points[c == _UNKNOWN]))
            c = self._class[points]
        return c

    def entries(self, columns: np.ndarray) -> np.ndarray:
        """The state each chunk begins in. ``columns``: classes, a row for each place in a chunk and
        a column for each chunk."""
        m = np.zeros(columns.shape[1], np.intp)
        for c in columns:
            m = self._after[m * self._n + c]
        step = 1
        while step < len(m):  # inclusive scan: each round composes with the map of twice as many chunks
            m[step:] = self._compose[m[:-step], m[step:]]
            step *= 2
        out = np.full(len(m), _FRESH, np.intp)
        out[1:] = self.maps[m[:-1], _FRESH]
        return out

    def starts(self, points: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each code point. 0x110000 ends a segment, stands last, and is a
        piece by itself."""
        n, w = len(points), self.width
        chunks = -(-n // w)
        c = np.full(chunks * w, _END, np.uint8)
        c[:n] = self.classes(points)
        columns = np.ascontiguousarray(c.reshape(chunks, w).T)
        state = self.entries(columns)
        marks = np.empty(columns.shape, np.uint8)
        for i, col in enumerate(columns):
            at = state * self._n + col
            marks[i] = self._mark[at]
            state = self._next[at]
        flat = marks.T.ravel()[:n]
        begins = (flat & _BEFORE).astype(bool)
        earlier = np.flatnonzero(flat & _EARLIER)
        begins[earlier - 1] = True
        return begins


class PieceCounter:
    """Numbers of tokens of pieces, by a transducer whose states are built as they are reached."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int]], max_states: int = 300_000, bits: int = 21):
        self._parts = {len(tokens) - len(merges) + i: p for i, p in enumerate(merges)}
        self._pair = {p: t for t, p in self._parts.items()}
        self._max, self._bits, self._shift = max_states, bits, np.uint64(64 - bits)
        self._child: dict[int, int] = {}
        self._fail, self._depth, self._token = [0], [0], [-1]
        for t, data in enumerate(tokens):
            node = 0
            for b in data:
                k = node << 8 | b
                if k not in self._child:
                    self._child[k] = len(self._fail)
                    self._fail.append(0)
                    self._depth.append(self._depth[node] + 1)
                    self._token.append(-1)
                node = self._child[k]
            self._token[node] = t
        for k in sorted(self._child, key=lambda k: self._depth[k >> 8]):
            f, b = self._fail[k >> 8], k & 255
            while f and (f << 8 | b) not in self._child:
                f = self._fail[f]
            self._fail[self._child[k]] = self._child[f << 8 | b] if k >> 8 else 0
        self._edges: dict[tuple[int, int], list] = {}
        self.begin = (0, 512)
        self._forget()

    def _forget(self) -> None:
        self._ids, self._states, self._apart, self._held = {self.begin: 0}, [self.begin], {}, 0
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._values = np.zeros(1 << self._bits, np.int64)

    def _edge(self, token: int, side: int) -> list:
        """(symbol, rank at which it merges away) of the symbols that stand at a token's left
        (side 0) or right (1) end while it is merged, earliest first."""
        got = self._edges.get((token, side))
        if got is None:
            chain = [token]
            while chain[-1] in self._parts:
                chain.append(self._parts[chain[-1]][side])
            chain.reverse()
            got = self._edges[token, side] = list(zip(chain, [*chain[1:], 1 << 40]))
        return got

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging keeps the tokens ``a`` and ``b`` side by side. They meet if symbols at
        their common edge have a merge that comes while both are there; of equal merges the left goes first."""
        key = a << 20 | b
        known = self._apart.get(key)
        if known is None:
            left, right, i, j, known = self._edge(a, 1), self._edge(b, 0), 0, 0, True
            while i < len(left) and j < len(right):
                (x, x_ends), (y, y_ends) = left[i], right[j]
                m = self._pair.get((x, y))
                if m is not None and m < x_ends and m <= y_ends:
                    known = False
                    break
                i, j = (i + 1, j) if x_ends < y_ends else (i, j + 1) if y_ends < x_ends else (i + 1, j + 1)
            self._apart[key] = known
        return known

    def advance(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after ``byte`` and the change of the number of tokens. A state is a trie node
        and, for it and each node on its way of failures down to the root, the token before that
        suffix plus 1 (0: the piece begins there) times 1024, plus 512 and the tokens since."""
        node, child, fail, depth = state[0], self._child, self._fail, self._depth
        entry, v, i = {}, node, 1
        while True:
            entry[depth[v]] = state[i]
            if not v:
                break
            v, i = fail[v], i + 1
        while (node << 8 | byte) not in child:
            node = fail[node]  # every byte is a child of the root
        node = v = child[node << 8 | byte]
        chain = []
        while v:
            chain.append(entry[depth[v] - 1])
            v = fail[v]
        v, last, change = node, -1, 0
        for e in chain:
            t = self._token[v]
            if t >= 0 and (e < 1024 or self._stay_apart((e >> 10) - 1, t)):
                last, change = t, 513 - (e & 1023)
                break
            v = fail[v]
        return (node, *[e + change for e in chain], (last + 1) << 10 | 512), change

    def _learn(self, key: int) -> int:
        new, change = self.advance(self._states[key >> 8], key & 255)
        i = self._ids.get(new)
        if i is None:
            i = self._ids[new] = len(self._states)
            self._states.append(new)
        return i << 10 | change + 512

    def _insert(self, keys: np.ndarray, values: list[int]) -> None:
        mask, held, kept = (1 << self._bits) - 1, self._keys, self._values
        for k, v, slot in zip(keys.tolist(), values, _slots(keys, self._shift).tolist()):
            while held[slot] != -1:
                slot = slot + 1 & mask
            held[slot], kept[slot] = k, v
        self._held += len(values)

    def _look_up(self, key: np.ndarray) -> np.ndarray:
        """The transitions of ``key``, state times 256 plus byte."""
        slot = _slots(key, self._shift)
        out = self._values[slot]
        miss = np.flatnonzero(self._keys[slot] != key)
        if len(miss):
            slot, new = slot[miss], []
            while len(miss):
                found = self._keys[slot]
                empty, hit = found == -1, found == key[miss]
                out[miss[hit]] = self._values[slot[hit]]
                if empty.any():
                    new.append(miss[empty])
                go = ~(empty | hit)
                miss, slot = miss[go], slot[go] + 1 & (1 << self._bits) - 1
            if new:
                at = np.concatenate(new)
                keys, back = np.unique(key[at], return_inverse=True)
                values = [self._learn(k) for k in keys.tolist()]
                self._insert(keys, values)
                out[at] = np.array(values)[back]
        return out

    def _alone(self, data: bytes, state: tuple) -> int:
        """The change over a long piece's rest, read by itself."""
        total, cache = 0, {}
        for b in data:
            got = cache.get((state, b))
            if got is None:
                got = self.advance(state, b)
                if len(cache) < 20_000:
                    cache[state, b] = got
            state, total = got[0], total + got[1]
        return total

    def counts(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, slice_bytes: int = 1 << 19) -> np.ndarray:
        """Tokens of the pieces raw[start : start + size], slices of them at a time."""
        out = np.zeros(len(starts), np.int64)
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(slice_bytes, int(sizes.sum()) + slice_bytes, slice_bytes))
        a = 0
        for b in np.unique(np.append(cuts + 1, len(starts))).tolist():
            b = min(b, len(starts))
            if b > a:
                out[a:b] = self._slice(raw, starts[a:b], sizes[a:b])
            a = b
        return out

    def _slice(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if len(self._states) > self._max or self._held > 1 << self._bits - 2:
            self._forget()
        order = np.argsort(-sizes, kind="stable")
        at, size = starts[order], sizes[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        ends = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right") if len(at) else []
        for k, n in enumerate(np.asarray(ends).tolist()):
            if n < 4 and k > 64:  # the rest of a few long pieces
                for i in range(n):
                    total[i] += self._alone(raw[at[i] + k : at[i] + size[i]].tobytes(), self._states[state[i]])
                break
            v = self._look_up(state[:n] << 8 | raw[at[:n] + k])
            state[:n] = v >> 10
            total[:n] += (v & 1023) - 512
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out


def _slots(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.intp)


class TokenCounter:
    """``counts(texts)`` gives each text's number of tokens, as the library's encode does without
    special tokens of its own; special strings in a text are one token each, as by its default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        spec = json.loads(lib.to_str())
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path}: not a byte-level BPE vocabulary with the usual split")
        self._specials = [t["content"] for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens that take in their surroundings")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocab, special = spec["model"]["vocab"], set(self._specials)
        order = sorted((t for t in vocab if t not in special), key=vocab.get)
        number = {t: i for i, t in enumerate(order)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        if [number[a + b] for a, b in pairs] != list(range(len(order) - len(pairs), len(order))):
            raise ValueError(f"{path}: token ids are not in the order of the merges")
        self._splitter = Splitter(lib.pre_tokenizer.pre_tokenize_str)
        self._counter = PieceCounter([bytes(byte[c] for c in t) for t in order], [(number[a], number[b]) for a, b in pairs])

    def _segments(self, text: str) -> list[str]:
        parts = [text]
        for s in self._specials:
            if s in text:
                parts = [x for p in parts for x in p.split(s)]
        return parts

    def counts(self, texts: list[str | None]) -> np.ndarray:
        if len(self._specials) > 1 and any(s in t for t in texts if t for s in self._specials):
            raise ValueError("texts with several kinds of special strings are not supported")
        segments, of = [], []
        for i, t in enumerate(texts):
            parts = self._segments(t or "")
            segments += parts
            of += [i] * len(parts)
        owner = np.array(of, np.int64)
        total = np.bincount(owner, minlength=len(texts)) - 1  # special strings
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        joined = "".join(segments)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        ends = np.cumsum(sizes + 1) - 1  # places of the ends of segments
        inner = np.ones(len(points) + len(segments), bool)
        inner[ends] = False
        symbols = np.full(len(inner), 0x110000, np.uint32)
        symbols[inner] = points
        first = np.flatnonzero(self._splitter.starts(symbols))
        first = first[inner[first]]
        if len(raw) == len(points):
            at = first - np.searchsorted(ends, first)
        else:
            width = np.where(inner, 1 + (symbols > 0x7F) + (symbols > 0x7FF) + (symbols > 0xFFFF), 0)
            at = (np.cumsum(width) - width)[first]
        per_piece = self._counter.counts(raw, at, np.diff(np.append(at, len(raw))))
        place = owner[np.searchsorted(ends, first)]
        return total + np.bincount(place, per_piece, len(texts)).astype(np.int64)


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """This worker's counter for a vocabulary file; kept between tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def count_tokens(docs: DataFrame, limit: int = 1024, tokenizer_path: str | None = None, max_chars: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row's whole
    text; nothing is shuffled. Null and empty texts have 0 of both; null and repeated ids keep
    their rows; an empty table gives no rows; columns other than doc_id and text are ignored.
    Texts go in slices of about ``max_chars`` characters, a longer one by itself, in time that
    grows with its length.
    """
    bound_batches(docs.sparkSession)
    path = tokenizer_path or default_path()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        from .tokens import batches_of_texts

        machine = counter(path)
        for batch in batches:
            found = [machine.counts(texts) for _, texts in batches_of_texts(batch, max_chars)]
            n = np.concatenate(found) if found else np.zeros(0, np.int64)
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.record_batch([batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
