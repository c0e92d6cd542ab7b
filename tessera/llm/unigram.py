"""Token counts of a unigram model, by dynamic programming over a trie of the distinct pre-tokens."""

from __future__ import annotations

import math
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import exchange
from tessera.llm.shared import WORD, resident

MARK = "▁"
_words = re.compile(WORD).findall


def zipf_scores(path: str) -> dict[bytes, float]:
    """Log probabilities for the pieces of a sentencepiece file, which lists them by rank: as Zipf's law has them.

    Pieces with a word mark past their start are left out: no pre-token holds them."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) or MARK in p.id_to_piece(i)[1:])]
    total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    return {p.id_to_piece(i).encode(): -math.log(r + 1) - total for r, i in enumerate(plain)}


class Unigram:
    """Pieces with log probabilities; any single byte is a piece too, less likely by `fallback` than the least likely."""

    def __init__(self, scores: dict[bytes, float], fallback: float = 10.0, width: int = 48):
        floor = min(scores.values(), default=0.0) - fallback
        self.scores = {bytes([b]): floor for b in range(256)} | scores
        self.width = width
        self.longest = max(map(len, self.scores))
        self.tables = []
        for length in range(1, self.longest + 1):
            pieces = [(p, s) for p, s in self.scores.items() if len(p) == length]
            hashed = np.array([self._hash(p) for p, _ in pieces], np.uint64)
            order = np.argsort(hashed)
            self.tables.append((hashed[order], np.array([s for _, s in pieces])[order]))

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * 0x100000001B3 + b + 1) % 2**64
        return h

    def one(self, word: bytes) -> int:
        """Tokens of the likeliest segmentation, ties to fewer tokens; a word by itself."""
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            best.append(max((best[a][0] + self.scores[word[a:end]], best[a][1] - 1) for a in range(max(0, end - self.longest), end) if word[a:end] in self.scores))
        return -best[-1][1]

    def count(self, words: list[bytes]) -> list[int]:
        """Tokens of each of the words, which are distinct and sorted.

        Sorted words are their trie: a node, which is a prefix, belongs to the first word that has it, and is scored once.
        Words of like length are walked together, level by level; where these are few, one after the other.
        """
        out, lengths, most = np.zeros(len(words), np.int64), np.array([len(w) for w in words], np.int64), self.width
        left = np.flatnonzero(lengths)
        while len(left):
            now, left = left[lengths[left] <= most], left[lengths[left] > most]
            if len(now) >= 32:
                each = max(1, (1 << 22) // most)
                for at in range(0, len(now), each):
                    some = now[at : at + each]
                    out[some] = self._levels([words[i] for i in some.tolist()])
            elif len(now):
                out[now] = self._walk([words[i] for i in now.tolist()])
            most *= 4
        return out.tolist()

    def _walk(self, words: list[bytes]) -> list[int]:
        """The trie depth first: what a word shares with the one before it stays on the stack of scores."""
        score, tokens, before, out = array("d", [0.0]), array("q", [0]), b"", []
        for word in words:
            shared = len(os.path.commonprefix([before, word]))
            del score[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, fewest = max((score[a] + self.scores[word[a:end]], tokens[a] - 1) for a in range(max(0, end - self.longest), end) if word[a:end] in self.scores)
                score.append(best)
                tokens.append(fewest)
            before = word
            out.append(-tokens[-1])
        return out

    def _levels(self, words: list[bytes]) -> np.ndarray:
        """The trie level by level: all nodes of a depth get their forward score from the nodes up to `longest` bytes above
        them; what stands at a word's last node is its count."""
        n, lengths = len(words), np.array([len(w) for w in words])
        deep = int(lengths.max())
        letters = np.frombuffer(b"".join(w.ljust(deep, b"\0") for w in words), np.uint8).reshape(n, deep)
        inside = np.arange(deep)[None] < lengths[:, None]
        same = np.zeros((n, deep), bool)
        same[1:] = np.logical_and.accumulate((letters[1:] == letters[:-1]) & inside[1:] & inside[:-1], 1)
        rows = np.arange(n)
        owner = np.zeros((n, deep + 1), np.int32)  # which word a word's prefix of each length belongs to
        for d in range(1, deep + 1):
            owner[:, d] = np.maximum.accumulate(np.where(same[:, d - 1], 0, rows))
        score, tokens = np.zeros((n, deep + 1)), np.zeros((n, deep + 1), np.int32)
        hashed = [np.zeros(n, np.uint64) for _ in range(min(deep, self.longest))]  # of the last 1, 2, ... bytes
        letter = letters.astype(np.uint64) + np.uint64(1)
        for d in range(1, deep + 1):
            for length in range(min(d, self.longest), 1, -1):
                hashed[length - 1] = hashed[length - 2] * np.uint64(0x100000001B3) + letter[:, d - 1]
            hashed[0] = letter[:, d - 1].copy()
            new = np.flatnonzero(inside[:, d - 1] & ~same[:, d - 1])
            best, fewest = np.full(len(new), -np.inf), np.zeros(len(new), np.int32)
            for length in range(1, min(d, self.longest) + 1):
                known, value = self.tables[length - 1]
                if not len(known):
                    continue
                here = hashed[length - 1][new]
                at = np.minimum(np.searchsorted(known, here), len(known) - 1)
                hit = np.flatnonzero(known[at] == here)
                above = owner[new[hit], d - length]
                total, parts = score[above, d - length] + value[at[hit]], tokens[above, d - length] + 1
                better = (total > best[hit]) | (total == best[hit]) & (parts < fewest[hit])
                best[hit[better]], fewest[hit[better]] = total[better], parts[better]
            score[new, d], tokens[new, d] = best, fewest
        return tokens[owner[rows, lengths], lengths]


def count_tokens(docs: DataFrame, path: str, memo_words: int = 400_000) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) per row of docs (doc_id, text): tokens of the likeliest unigram segmentation.

    Pre-tokens are the runs of anything but ASCII white space in the whole text, each with the word mark before it.
    Distinct ones are segmented once a worker, which remembers memo_words of them at most. Null and empty texts have
    none; a null doc_id stays null; equal rows are counted each; segmentations that tie in score have the fewer tokens;
    texts and pre-tokens of any length go through the trie; other columns, of any name, are left alone; an empty table
    gives none.
    """

    def work(batches):
        model = resident(("unigram", path), lambda: Unigram(zipf_scores(path)))
        memo = model.__dict__.setdefault("memo", {})
        for b in batches:
            for part in exchange.slices(b):
                words = [_words(t.as_py() or "") for t in part.column(1)]
                wanted = {w for ws in words for w in ws}
                if len(memo) + len(wanted) > memo_words:
                    memo.clear()
                fresh = sorted((MARK + w).encode() for w in wanted if w not in memo)
                for at in range(0, len(fresh), 50_000):
                    some = fresh[at : at + 50_000]
                    memo.update(zip((w.decode()[len(MARK) :] for w in some), model.count(some), strict=True))
                n_tokens = [sum(map(memo.__getitem__, ws)) for ws in words]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(ws) for ws in words], pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(work, "doc_id long, n_pretokens long, n_tokens long")
