"""A SentencePiece vocabulary as arrays, for the operators that encode and count.

Texts are split, before anything else, where no piece can reach across: before a run of spaces and around control characters
that no piece holds. Equal parts (pre-tokens) have equal encodings, so each distinct one is worked out once.

Two kinds of model. ``unigram``: the encoding of a text is the path of pieces with the largest sum of scores. ``bpe``: merges
by rank make the encoding, and a path of pieces is the encoding exactly if each two neighbours, alone, would be encoded as
these two (``joins``). So either kind is found left to right, by relaxing the edges that end at each position: unigram keeps
the best sum, and BPE the one edge whose piece joins to the last piece of the encoding up to its start.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Codes beside piece ids: the start of a pre-token, a character that only its bytes can stand for.
START, UNKNOWN = -1, -2
_FAR = np.int64(1) << 40
#: Bytes from which a pre-token is relaxed by itself, edge by edge: side by side with others it would be a step a byte for all.
LONG = 512
PAIRS = 1_000_000  # pairs of pieces whose joining is kept while a pre-token is relaxed


def _merges(text: str, rank: dict[str, int]) -> list[tuple[str, int, int]]:
    """Merges by rank, leftmost first at a tie: the symbols left, with the sizes of the two parts each was last made of."""
    symbols = [(c, 0, 0) for c in text]
    after, before = [*range(1, len(text)), -1], [*range(-1, len(text) - 1)]
    todo = [(rank[p], i, p) for i in range(len(text) - 1) if (p := text[i : i + 2]) in rank]
    heapq.heapify(todo)
    while todo:
        _, i, p = heapq.heappop(todo)
        if symbols[i] is None or (j := after[i]) < 0 or symbols[i][0] + symbols[j][0] != p:
            continue
        symbols[i], symbols[j] = (p, len(symbols[i][0]), len(symbols[j][0])), None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (q := symbols[a][0] + symbols[b][0]) in rank:
                heapq.heappush(todo, (rank[q], a, q))
    return [s for s in symbols if s]


@dataclass
class Pieces:
    """text: the pieces that texts are matched with, a space where the model has its mark; ids, scores: the model's."""

    kind: str
    text: list[str]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    prefix: bool = True
    left: np.ndarray = field(init=False)
    right: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.utf8 = [t.encode() for t in self.text]
        self.lengths = np.array([len(b) for b in self.utf8], dtype=np.int64)
        known = set("".join(self.text))
        alone = "".join(re.escape(c) for c in map(chr, (*range(32), 127)) if c not in known)
        self.pattern = f"[{alone}]| *[^ {alone}]+| +" if alone else " *[^ ]+| +"
        self.worst = float(self.scores.min()) - 10 if len(self.scores) else -10.0
        self.usable = np.ones(len(self.text), dtype=bool)
        if self.kind == "bpe":
            self._derive()

    def _derive(self) -> None:
        order = np.lexsort((np.arange(len(self.text)), -self.scores))
        self.rank = np.empty(len(order), dtype=np.int64)
        # Equal scores are one rank: then the leftmost goes first.
        self.rank[order] = np.concatenate(([0], np.cumsum(np.diff(self.scores[order]) != 0))) if len(order) else 0
        number = {t: i for i, t in enumerate(self.text)}
        ranks = dict(zip(self.text, self.rank.tolist()))
        self.left, self.right = np.full(len(self.text), -1), np.full(len(self.text), -1)
        self.when = np.where([len(t) == 1 for t in self.text], -1, self.rank)
        pairs: dict[tuple[int, int], int] = {}
        for i in sorted(range(len(self.text)), key=lambda i: len(self.text[i])):
            t = self.text[i]
            if len(t) == 1:
                continue
            for k in range(1, len(t)):
                a, b = number.get(t[:k]), number.get(t[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
            made = _merges(t, ranks)
            self.usable[i] = len(made) == 1 and t[: made[0][1]] in number and t[made[0][1] :] in number
            if self.usable[i]:
                a, b = number[t[: made[0][1]]], number[t[made[0][1] :]]
                self.left[i], self.right[i] = a, b
                # A merge comes no sooner than those that made its parts.
                self.when[i] = max(self.rank[i], self.when[a], self.when[b])
        keys = np.array([a * len(self.text) + b for a, b in pairs], dtype=np.int64)
        at = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[at], np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[at]

    def joins(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For each pair of pieces: would merges leave both as they are, side by side? Codes below 0 join with all."""
        ok = np.ones(len(u), dtype=bool)
        todo = np.flatnonzero((u >= 0) & (t >= 0))
        a, b = u[todo], t[todo]
        a_ends = np.full(len(todo), _FAR)  # when, and by which rank, a merge inside u takes up its last symbol a; b in t
        b_ends, a_rank, b_rank = a_ends.copy(), a_ends.copy(), a_ends.copy()
        while len(todo):
            key = a * len(self.text) + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
            c = np.where(self.pair_keys[at] == key, self.pair_made[at], -1) if len(self.pair_keys) else np.full(len(key), -1)
            r = self.rank[c]
            when = np.maximum(r, np.maximum(self.when[a], self.when[b]))
            first_a = (when < a_ends) | ((when == a_ends) & (r < a_rank))
            first_b = (when < b_ends) | ((when == b_ends) & (r <= b_rank))
            bad = (c >= 0) & first_a & first_b
            ok[todo[bad]] = False
            # One merge back in time: of the two symbols, undo the one made later; the right one at a tie.
            wa, wb = self.when[a], self.when[b]
            back_a = wa > wb
            go = ~bad & ((wa >= 0) | (wb >= 0))
            a_ends, a_rank = np.where(back_a, wa, a_ends)[go], np.where(back_a, self.rank[a], a_rank)[go]
            b_ends, b_rank = np.where(back_a, b_ends, wb)[go], np.where(back_a, b_rank, self.rank[b])[go]
            a, b, todo = np.where(back_a, self.right[a], a)[go], np.where(back_a, b, self.left[b])[go], todo[go]
        return ok

    def distinct_joins(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """``joins``, once for each distinct pair. The codes go down to UNKNOWN, so both are counted from there."""
        n = len(self.text) - UNKNOWN
        keys, back = np.unique((u.astype(np.int64) - UNKNOWN) * n + (t - UNKNOWN), return_inverse=True)
        return self.joins(keys // n + UNKNOWN, keys % n + UNKNOWN)[back]

    def _one_joins(self, u: int, t: int) -> bool:
        """``joins`` of a single pair."""
        if u < 0 or t < 0:
            return True
        if not hasattr(self, "_made"):  # of use for long pre-tokens only
            made = zip(*(x.tolist() for x in np.divmod(self.pair_keys, len(self.text))))
            self._made, self._ranks, self._whens = dict(zip(made, self.pair_made.tolist())), self.rank.tolist(), self.when.tolist()
        rank, when, made = self._ranks, self._whens, self._made
        a, b = u, t
        a_ends = b_ends = a_rank = b_rank = int(_FAR)
        while True:
            c = made.get((a, b), -1)
            wa, wb = when[a], when[b]
            if c >= 0:
                r = rank[c]
                w = max(r, wa, wb)
                if (w, r) < (a_ends, a_rank) and (w < b_ends or (w == b_ends and r <= b_rank)):
                    return False
            if wa < 0 and wb < 0:
                return True
            if wa > wb:
                a_ends, a_rank, a = wa, rank[a], int(self.right[a])
            else:
                b_ends, b_rank, b = wb, rank[b], int(self.left[b])

    def path(self, edges: Iterator[tuple[int, int, int, bool]], size: int) -> tuple[list[int], list[int]]:
        """Relaxes the edges (start, end, piece, whether the last to its end) of one long pre-token of ``size`` bytes, by end
        and the longest first. Returns, for each position, the last piece and where it starts (-1: no encoding ends there)."""
        last, back = [START] * (size + 1), [-1] * (size + 1)
        known: dict[tuple[int, int], bool] = {}
        if self.kind == "unigram":
            best, worst, scores = [-math.inf] * (size + 1), self.worst, self.scores.tolist()
            best[0] = 0.0
            for i, j, t, _ in edges:
                s = best[i] + (worst if t == UNKNOWN else scores[t])
                if s > best[j]:
                    best[j], last[j], back[j] = s, t, i
            return last, back
        for i, j, t, final in edges:
            if back[j] >= 0:
                continue
            u = last[i]
            ok = final
            if not ok and (ok := known.get((u, t))) is None:
                if len(known) > PAIRS:
                    known.clear()
                ok = known[u, t] = self._one_joins(u, t)
            if ok:
                last[j], back[j] = t, i
        return last, back

    def pretokens(self, text: str) -> list[str]:
        if not text:
            return []
        return re.findall(self.pattern, (" " if self.prefix else "") + text.replace(SPACE, " "))


def load(path: str = MODEL) -> Pieces:
    """From a SentencePiece model file whose normaliser is the identity."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    p = SentencePieceProcessor(model_file=path)
    m = proto.ModelProto()
    m.ParseFromString(p.serialized_model_proto())
    if m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces or not p.id_to_piece(0) or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models that change nothing but spaces can be used")
    kinds = {proto.TrainerSpec.BPE: "bpe", proto.TrainerSpec.UNIGRAM: "unigram"}
    normal = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    text = [p.id_to_piece(i).replace(SPACE, " ") for i in normal]
    if any(" " in t.lstrip(" ") for t in text):
        raise ValueError("a piece goes on behind a space")
    byte_ids = np.array([p.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    return Pieces(kinds[m.trainer_spec.model_type], text, np.array(normal), np.array([p.get_score(i) for i in normal]), byte_ids, m.normalizer_spec.add_dummy_prefix)
