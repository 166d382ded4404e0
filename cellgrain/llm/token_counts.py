"""Token counts of a BPE vocabulary by a deterministic transducer.

The BPE encoding of a text is a sequence of tokens in which every neighbouring
pair is stable (encoding the pair alone gives the pair back), and for every
prefix of a text there is exactly one such sequence.  So one pass from left to
right suffices: the state holds, for every earlier position from which a token
may still end later, the trie node reached from there, the last token before
it and its token count relative to now.  States are numbered as they appear,
and each transition carries the change of the token count (`Transducer.step`).

A piece never holds a space marker after another character, so the transducer
is in its start state wherever a run of spaces begins.  A text cut anywhere
gives chunks whose effect is a `ChunkMap`: what it does before its first such
point depends on the state it is entered in, the tokens after that are
counted, and what it leaves open is handed on.  Maps compose associatively, so
the chunks of a text are counted independently and joined by a prefix scan.

Defined results: null and empty text have 0 tokens and 0 bytes; strings of
control tokens inside a text are ordinary text; characters without a piece give
one byte token for each UTF-8 byte.  Rows without an id are left out; repeated
rows are counted one by one; an empty table gives no rows; a very long text is
counted whole, chunk by chunk; columns beyond doc_id and text are not looked at.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import texts_of

SPACE = "▁"
CHUNK = 1 << 16
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
_START, _OTHER = -1, -2


class ChunkMap(NamedTuple):
    """What a chunk does: `head` before its first restart, `count` tokens of whole words after it, `tail` left open.

    `count` is None for a chunk without a restart; its text is then all head.
    """

    head: str
    count: int | None
    tail: str


class Transducer:
    """Lazily determinised BPE transducer over characters; at most `limit` states are kept."""

    def __init__(self, pieces: dict[str, float], limit: int = 150_000):
        self.score, self.limit = pieces, limit
        self.child: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        for piece in pieces:
            node = 0
            for c in piece:
                nxt = self.child[node].get(c)
                if nxt is None:
                    nxt = self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                node = nxt
            self.token[node] = piece
        # a character that occurs only inside longer pieces is still a symbol of its own, spelled in bytes
        for c, node in self.child[0].items():
            if self.token[node] is None:
                self.token[node] = c
        self.stable: dict[tuple, bool] = {}
        self.words: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((0, _START, 0),)]
        self.ids: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def emitted(self, token: str) -> int:
        return 1 if token in self.score else len(token.encode("utf-8", "surrogatepass"))

    def encode(self, text: str) -> list[str]:
        """Plain BPE of a short string: merge the best pair, leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_stable(self, left, right: str) -> bool:
        key = (left, right)
        known = self.stable.get(key)
        if known is None:
            known = self.encode(right) == [right] if isinstance(left, int) else self.encode(left + right) == [left, right]
            if len(self.stable) > 500_000:
                self.stable.clear()
            self.stable[key] = known
        return known

    def step(self, state: int, char: str) -> tuple[int, int]:
        """(next state, change of the token count); compiled on first use."""
        key = state << 21 | ord(char)
        move = self.moves.get(key)
        if move is None:
            open_, found = [], None
            for node, last, rel in self.states[state]:
                node = self.child[node].get(char)
                if node is None:
                    continue
                token = self.token[node]
                if found is None and token is not None and self.is_stable(last, token):
                    found = token, rel + self.emitted(token)
                if self.child[node]:
                    open_.append((node, last, rel))
            if found is None:  # no piece has this character
                found = _OTHER, len(char.encode("utf-8", "surrogatepass"))
            last, delta = found
            nxt = (*((node, before, rel - delta) for node, before, rel in open_), (0, last, 0))
            at = self.ids.get(nxt)
            if at is None:
                at = self.ids[nxt] = len(self.states)
                self.states.append(nxt)
            move = self.moves[key] = at, delta
        return move

    def run(self, text: str) -> int:
        """Tokens of one word from the start state."""
        state = total = 0
        for c in text:
            state, delta = self.step(state, c)
            total += delta
        if len(self.states) > self.limit:
            self.reset()
        return total

    def count_words(self, words: list[str]) -> None:
        """Counts of new words, all words in step: one column of characters at a time."""
        words = sorted(words, key=len, reverse=True)
        long = [w for w in words if len(w) > 64]
        for w in long:
            self.words[w] = self.run(w)
        words = words[len(long) :]
        if not words:
            return
        length = np.array([len(w) for w in words])
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.r_[0, np.cumsum(length)][:-1]
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for t in range(int(length[0])):
            k = int(np.searchsorted(-length, -t, side="left"))
            keys, back = np.unique(state[:k] << 21 | flat[first[:k] + t], return_inverse=True)
            get, step = self.moves.get, self.step
            moves = np.array([get(key) or step(key >> 21, chr(key & 0x1FFFFF)) for key in keys.tolist()], np.int64)
            state[:k] = moves[back, 0]
            total[:k] += moves[back, 1]
        self.words.update(zip(words, total.tolist(), strict=True))
        if len(self.states) > self.limit:
            self.reset()

    def learn(self, words: set[str]) -> None:
        """Have the counts of these words at hand."""
        new = words - self.words.keys()
        if new:
            if len(self.words) > 300_000:
                self.words.clear()
                new = words
            self.count_words(list(new))

    def count(self, words: list[str]) -> int:
        self.learn(set(words))
        return sum(map(self.words.__getitem__, words))

    def chunk_map(self, chunk: str) -> ChunkMap:
        cut = re.search(f"(?<=[^{SPACE}]){SPACE}", chunk)
        if cut is None:
            return ChunkMap(chunk, None, "")
        words = _WORD.findall(chunk, cut.start())
        return ChunkMap(chunk[: cut.start()], self.count(words[:-1]), words[-1])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.count is None and b.count is None:
            # a restart can lie between the two
            if a.head and a.head[-1] != SPACE and b.head.startswith(SPACE):
                return ChunkMap(a.head, 0, b.head)
            return ChunkMap(a.head + b.head, None, "")
        if a.count is None:
            if a.head and a.head[-1] != SPACE and b.head.startswith(SPACE):
                return ChunkMap(a.head, self.count(_WORD.findall(b.head)) + b.count, b.tail)
            return ChunkMap(a.head + b.head, b.count, b.tail)
        words = _WORD.findall(a.tail + b.head)
        if b.count is None:
            return ChunkMap(a.head, a.count + self.count(words[:-1]), words[-1])
        return ChunkMap(a.head, a.count + self.count(words) + b.count, b.tail)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """Reduction tree of a prefix scan: neighbours are joined until one map is left."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def count_text(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text as the library gives them, with its leading space marker."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if len(text) <= chunk:
            return self.count(_WORD.findall(text))
        whole = self.scan([self.chunk_map(text[k : k + chunk]) for k in range(0, len(text), chunk)])
        return self.count(_WORD.findall(whole.head)) + (whole.count or 0) + (self.count(_WORD.findall(whole.tail)) if whole.tail else 0)

    def count_texts(self, texts: list[str], together: int = 1 << 20) -> list[int]:
        """count_text of each; the new words of about `together` characters run through the transducer in step."""
        out, k = [], 0
        while k < len(texts):
            batch, size = [], 0
            while k + len(batch) < len(texts) and size < together:
                text = texts[k + len(batch)]
                size += len(text)
                batch.append(_WORD.findall(SPACE + text.replace(" ", SPACE)) if 0 < len(text) < CHUNK else None)
            self.learn(set().union(*(b for b in batch if b)))
            get = self.words.__getitem__
            now = [None if b is None else sum(map(get, b)) for b in batch]
            out += [self.count_text(texts[k + j]) if n is None else n for j, n in enumerate(now)]
            k += len(batch)
        return out


def load_pieces(path: str) -> dict[str, float]:
    """Piece -> score of the ordinary pieces of a sentencepiece BPE file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a vocabulary file, one for each Python worker."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(load_pieces(path))
    return _COMPILED[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) for every row of `docs` with an id; no shuffle.

    `path` is a sentencepiece BPE file that executors can read.
    """

    def run(batches):
        machine = transducer(path)
        for batch in batches:
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            n = machine.count_texts(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([ids, pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
