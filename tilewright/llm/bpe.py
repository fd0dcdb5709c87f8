"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A text is cut by the vocabulary's split pattern. Within a piece an Aho-Corasick automaton gives the longest token at every
byte; the encoder takes longest matches from the left and checks each neighbouring pair against a compatibility table. Two
tokens are compatible if no merge ever joins what lies left and right of the border between them; a sequence whose pairs
are all compatible is the one that the merges make, and there is exactly one. Where a pair fails the encoder tries the
next shorter token, and where none is left it goes back and marks the place as dead, so each place is left at most once:
the work is linear in the text. Pieces that came before are looked up. Decoding copies each id's bytes from one buffer by
a table of offsets.

Null text is empty: no ids, and decoded as the empty string. Special tokens of the file are found in a text first, as the
tokenizers library finds them. Repeated rows are encoded each, an empty table gives no rows, whole texts are read in parts
of bounded size, and further columns pass through; a column named as a result is refused with ValueError.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tilewright.llm.common import slices
from tilewright.llm.packing import SPLIT, byte_names

#: Pieces of up to so many characters are remembered, and so many of them; a full store is emptied.
REMEMBERED_CHARS, REMEMBERED = 48, 1 << 19
#: Pieces of up to so many bytes go through the automaton side by side, longer ones alone.
TOGETHER = 512
#: So many pairs of tokens are remembered in the compatibility table.
PAIRS = 1 << 20
#: Below this code point all editions of Unicode agree on letters, numbers and spaces.
SETTLED = 0x530


class Merges:
    """What encoder and decoder need of a byte-level file: token bytes, the merge behind each token, and the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split, decoder = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and decoder.get("type") == "ByteLevel"
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or not plain or odd or any(t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} is no plain byte-level file of byte pairs")
        names, vocab = byte_names(), model["vocab"]
        n = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes | None] = [None] * n
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes[i] = bytes(names[c] for c in token)
        #: (left id, right id) -> rank, and joined id -> (left id, right id, rank)
        self.joins, self.parts = {}, {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if whole in self.parts:
                raise ValueError(f"{path} makes token {whole} by more than one merge")
            self.joins[left, right] = rank
            self.parts[whole] = (left, right, rank)
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        made = self._made()
        ids = {t: i for i, t in enumerate(self.bytes) if t is not None and i in made}
        self.goto, self.longest_at = self._automaton(ids)
        #: for each token its length, and the longest token that is a shorter beginning of it (-1: none)
        self.size = [len(t or b"") for t in self.bytes]
        self.shorter = [-1] * n
        for token, i in ids.items():
            self.shorter[i] = next((ids[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ids), -1)
        self.sizes = np.array(self.size, dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.buffer = np.frombuffer(b"".join(t or b"" for t in self.bytes), dtype=np.uint8)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of a token's merge tree, each with the rank at which it goes up in the next."""
        out, gone, at = [(token, float("inf"))], float("inf"), token
        while at in self.parts:
            gone, at = self.parts[at][2], self.parts[at][side]
            out.append((at, gone))
        self.edges[token, side] = out
        return out

    def apart(self, left: int, right: int, until: float = float("inf")) -> bool:
        """Whether no merge of a rank below `until` crosses the border between two tokens.

        A merge of x, at the right edge of the left token, with y, at the left edge of the right one, happens if its rank comes before both
        have gone up in larger tokens; of equal ranks the leftmost goes first.
        """
        joins, edge = self.joins, self.edges.get((right, 0)) or self._edge(right, 0)
        for x, x_gone in self.edges.get((left, 1)) or self._edge(left, 1):
            most = min(until, x_gone)
            for y, y_gone in edge:
                rank = joins.get((x, y))
                if rank is not None and rank < most and rank <= y_gone:
                    return False
        return True

    def _made(self) -> set[int]:
        """The tokens that the merges do make from their own bytes."""
        made = {i for i, t in enumerate(self.bytes) if t is not None and len(t) == 1}
        for whole, (left, right, rank) in sorted(self.parts.items(), key=lambda p: p[1][2]):
            if left in made and right in made and self.apart(left, right, rank):
                made.add(whole)
        return made

    def compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[left << 32 | right] = self.apart(left, right)
        return found

    def _automaton(self, ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Aho-Corasick over the tokens read backwards: next state by (state, byte), and the longest token that ends in a state.

        Fed with a piece from its end, it has at each byte the longest token that starts there.
        """
        sons, parent, byte, own, depth = [{}], [0], [0], [-1], [0]
        for token, i in ids.items():
            at = 0
            for c in reversed(token):
                if c not in sons[at]:
                    sons[at][c] = len(sons)
                    sons.append({})
                    parent.append(at)
                    byte.append(c)
                    own.append(-1)
                    depth.append(depth[at] + 1)
                at = sons[at][c]
            own[at] = i
        parent, byte, own, depth = (np.array(x, dtype=np.int32) for x in (parent, byte, own, depth))
        goto, fail = np.zeros((len(own), 256), dtype=np.int32), np.zeros(len(own), dtype=np.int32)
        for level in range(int(depth.max()) + 1):
            here = np.flatnonzero(depth == level)
            if level > 1:
                fail[here] = goto[fail[parent[here]], byte[here]]
            if level:
                goto[here] = goto[fail[here]]
                own[here] = np.where(own[here] < 0, own[fail[here]], own[here])
            below = np.flatnonzero(depth == level + 1)
            goto[parent[below], byte[below]] = below
        return goto, own

    def _longest(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest token at each byte of pieces that lie one after the other; all pieces advance together, from their ends."""
        out = np.full(len(raw) + 1, -1, dtype=np.int64)
        for i in np.flatnonzero(ends - starts > TOGETHER).tolist():
            at, found = 0, []
            for c in raw[starts[i] : ends[i]][::-1].tolist():
                at = self.goto[at, c]
                found.append(at)
            out[starts[i] : ends[i]] = self.longest_at[found[::-1]]
        order = np.argsort(starts - ends, kind="stable")
        order = order[(ends - starts)[order] <= TOGETHER]
        sizes, at, state = (ends - starts)[order], ends[order], np.zeros(len(order), dtype=np.int32)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            n = int(np.searchsorted(-sizes, -step, side="right"))  # so many pieces are that long
            place = at[:n] - step
            state = self.goto[state[:n], raw[place]]
            out[place] = self.longest_at[state]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece (none is empty). Where the longest matches from the left fit together they are the answer, else backtracking finds it."""
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate([[0], ends[:-1]])
        longest = self._longest(raw, starts, ends)
        fits, ids = ends - starts <= TOGETHER, [[] for _ in pieces]
        active = np.flatnonzero(fits)
        at, before = starts[active], np.full(len(active), -1)
        while len(active):
            token = longest[at]
            keys, inverse = np.unique(before << 32 | token, return_inverse=True)
            fine = [k < 0 or (self.compatible(k >> 32, k & 0xFFFFFFFF) if (f := self.pairs.get(k)) is None else f) for k in keys.tolist()]
            good = np.array(fine)[inverse]
            fits[active[~good]] = False
            at = at + self.sizes[token]
            for i, t in zip(active[good].tolist(), token[good].tolist(), strict=True):
                ids[i].append(t)
            on = good & (at < ends[active])
            active, at, before = active[on], at[on], token[on]
        left = np.flatnonzero(~fits).tolist()
        longest = longest.tolist() if left else []
        for i in left:
            ids[i] = self._backtrack(longest, int(starts[i]), int(ends[i]))
        return ids

    def _backtrack(self, longest: list[int], start: int, stop: int) -> list[int]:
        size, shorter, pairs, dead = self.size, self.shorter, self.pairs, set()
        out, at, token = [], start, longest[start]
        while at < stop:
            last = out[-1] if out else -1
            while token >= 0:
                if at + size[token] not in dead:
                    if last < 0:
                        break
                    fits = pairs.get(last << 32 | token)
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at]
            else:  # nothing fits behind the last token: this place is dead, and that token has to be shorter
                dead.add(at)
                out.pop()
                at -= size[last]
                token = shorter[last]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, ids outside the file are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.bytes))]
        size = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.offsets[ids] - ends + size, size)
        return self.buffer[take].tobytes().decode("utf-8", errors="replace")


class Encoder:
    """texts -> int32 arrays of ids, as the tokenizers library gives them for the file at path."""

    def __init__(self, path: str):
        import regex
        from tokenizers import pre_tokenizers

        self.merges = merges(path)
        self.words = regex.compile(SPLIT)
        self.unsettled = regex.compile(f"[{chr(SETTLED)}-\U0010ffff]")
        self.odd = None
        self.by_library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.known: dict[str, bytes] = {}
        self.names = byte_names()

    def _odd(self):
        """Code points that the two regular-expression libraries put into different classes; found once by trying all."""
        import regex
        from tokenizers import Regex, pre_tokenizers

        every = "".join(map(chr, [*range(SETTLED, 0xD800), *range(0xE000, 0x110000)]))
        differ: set[str] = set()
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            cut = pre_tokenizers.Split(Regex(kind), "removed", invert=True)
            differ |= set(regex.findall(kind, every)) ^ {c for c, _ in cut.pre_tokenize_str(every)}
        return regex.compile("[" + "".join(map(regex.escape, sorted(differ))) + "]") if differ else regex.compile(r"(?!)")

    def pieces(self, text: str) -> list[str]:
        if self.unsettled.search(text):
            if self.odd is None:
                self.odd = self._odd()
            if self.odd.search(text):
                names = self.names
                return [bytes(names[c] for c in x).decode() for x, _ in self.by_library.pre_tokenize_str(text)]
        return self.words.findall(text)

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces that are not remembered; short ones are from now on."""
        new = list(pieces)
        made = self.merges.encode_pieces([p.encode() for p in new]) if new else []
        found = {p: array("i", ids).tobytes() for p, ids in zip(new, made, strict=True)}
        if len(self.known) + len(found) > REMEMBERED:
            self.known.clear()
        self.known.update((p, ids) for p, ids in found.items() if len(p) <= REMEMBERED_CHARS)
        return found

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        cut = []  # of each text its parts: an id of a special token, or the pieces of what lies between
        for text in texts:
            parts = self.special.split(text) if self.special and self.special.search(text) else [text]
            cut.append([self.merges.special[p] if k % 2 else self.pieces(p) for k, p in enumerate(parts)])
        need = {p for parts in cut for part in parts if not isinstance(part, int) for p in part}
        new = {p for p in need if p not in self.known}
        ids = {p: self.known[p] for p in need - new}
        ids.update(self._learn(new))
        of = ids.__getitem__
        return [np.frombuffer(b"".join([array("i", [part]).tobytes() if isinstance(part, int) else b"".join(map(of, part)) for part in parts]), dtype=np.int32) for parts in cut]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name} already")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def _encoded(whole: pa.RecordBatch, at: int, to_ids: Encoder, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(whole, at, size=1 << 22):
        found = to_ids([x or "" for x in batch.column(at).to_pylist()])
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=names)


def _decoded(whole: pa.RecordBatch, at: int, table: Merges, names: list[str]) -> Iterator[pa.RecordBatch]:
    for start in range(0, whole.num_rows, 256):
        batch = whole.slice(start, 256)
        texts = [table.decode(np.asarray(x.values if x.is_valid else [], dtype=np.int64)) for x in batch.column(at)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the array of token ids of each whole text."""
    at = docs.columns.index(text)
    schema = _with(docs, ids, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer)
        for whole in batches:
            yield from _encoded(whole, at, to_ids, schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of each array of ids; null ids give the empty string."""
    at = rows.columns.index(ids)
    schema = _with(rows, text, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(tokenizer)
        for whole in batches:
            yield from _decoded(whole, at, table, schema.names)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs without the text, but with its ids and their text: encode and decode in one pass, so that a task has one worker with one automaton, and
    neither texts nor ids go back and forth between them."""
    at, kept = docs.columns.index(text), [c for c in docs.columns if c != text]
    longer = _with(docs, ids, T.ArrayType(T.IntegerType(), False))
    schema = T.StructType([*docs.select(kept).schema.fields, longer[ids], T.StructField(decoded, T.StringType())])
    _with(docs, decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer)
        for whole in batches:
            for batch in _encoded(whole, at, to_ids, longer.names):
                yield from _decoded(batch.select([*kept, ids]), len(kept), to_ids.merges, schema.names)

    return docs.mapInArrow(run, schema)
