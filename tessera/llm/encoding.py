"""Exact, memoised use of the tokenizers library on long runs of text.

A text is cut where no pre-token can reach across, so that the ids of the pieces, one after the other, are the
ids of the text. Each distinct piece is encoded once per worker process and then looked up.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.shared import Memo, resident

#: Bytes of the texts whose pieces are told apart at once.
RUN = 1 << 23
#: What ends a run of letters in every pre-tokenizer pattern here, and never begins a contraction.
STOPS = "!\"#$%&()*+,-./:;=?@[]^{}~"


def encoder(path: str, memo_entries: int = 500_000) -> "Encoder":
    """This process's encoder of the tokenizer file at path, kept until the process needs something else."""
    return resident(("encoder", path, memo_entries), lambda: Encoder(path, memo_entries))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    """ids(text): the little-endian unsigned 32-bit ids of encode(text, add_special_tokens=False), as bytes.

    Two pre-tokenizers have a fast path: byte-level with its own pattern (a space belongs to the word after it)
    and a removing split followed by byte-level (white space dropped, lower case). All else is encoded whole.
    """

    def __init__(self, path: str, memo_entries: int):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials))).search if self.specials else None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        pre = spec.get("pre_tokenizer") or {}
        steps = [s["type"] for s in pre.get("pretokenizers", [])]
        norm = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        plain = spec["model"]["type"] == "BPE" and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) and not spec["model"].get("dropout")
        self.kind = ""
        if plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.kind = "spaced"
            #: The byte-level pre-tokenizer's pattern, a fixed value of that format.
            self.pretoken = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        elif plain and steps == ["Split", "ByteLevel"] and norm == ["NFC", "Replace", "Lowercase"] and pre["pretokenizers"][0]["invert"] and not pre["pretokenizers"][1]["add_prefix_space"]:
            self.kind = "dropped"
            self.pretoken = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.model = self.tokenizer.model
        self.bytes = "".join(byte_alphabet())
        self.words = Memo(self._word if self.kind == "dropped" else self._piece, memo_entries)
        self.separators = re.compile(r"[\x1c-\x1f]").search  # white space to str.split alone

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _model(self, pretoken: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(codecs.charmap_decode(pretoken.encode(), "strict", self.bytes)[0])]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha() or piece[1:].isalpha() and piece[0] == " ":
            return self._model(piece)
        if self.special and self.special(piece):
            return self._whole(piece)
        word = piece.rstrip(STOPS)
        if word.isalpha() or word[1:].isalpha() and word[0] == " ":
            return self.words[word] + self.words[piece[len(word) :]]
        parts = self.pretoken(piece)
        return self._model(piece) if len(parts) == 1 else b"".join([self.words[p] if len(p) < len(piece) else self._model(p) for p in parts])

    def _word(self, word: str) -> bytes:
        # other scripts have lower-case rules that depend on what stands around a letter
        if "<|" in word or max(word) > "ɏ" or not unicodedata.is_normalized("NFC", word):
            return self._whole(word)
        low = word.lower()
        if low != word:
            return self.words[low]
        if low.isalpha():
            return self._model(low)
        parts = self.pretoken(low)
        return self._model(low) if parts == [low] else b"".join([self.words[p] if len(p) < len(low) else self._model(p) for p in parts])

    @staticmethod
    def _plain(text: str) -> bool:
        """Whether single spaces and line ends, and no other white space, stand between words and nowhere else."""
        words, gaps = text.split(), text.count(" ") + text.count("\n")
        return len(words) == gaps + 1 and len("".join(words)) + gaps == len(text) and "\x01" not in text

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind == "dropped":
            if self.separators(text) or any(s in text for s in self.specials):
                return self._whole(text)
            return self.words.joined(text.split())
        if self.kind == "spaced" and self._plain(text):
            return self.words.joined(text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01"))
        return self._whole(text)

    def all_ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """ids() of each text of a run. The pieces of plain texts are told apart for all at once, so one that is frequent in
        them is looked up once; very long texts are taken alone, which needs less memory."""
        plain = [bool(t) and self.kind == "spaced" and len(t) <= RUN and self._plain(t) for t in texts]
        marked = pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.string())
        marked = pc.replace_substring(pc.replace_substring(marked, " ", "\x01 "), "\n", "\x01\n\x01")
        pieces = pc.split_pattern(marked, "\x01")
        words = pieces.flatten().dictionary_encode()
        known = pa.array(self.words.each(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary())
        ids = known.take(words.indices)
        _, bounds, data = ids.buffers()
        ends = np.frombuffer(bounds, np.int32)[np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1]].tolist() if len(ids) else []
        data, at = memoryview(data) if data else b"", 0
        for t, p in zip(texts, plain, strict=True):
            if p:
                yield bytes(data[ends[at] : ends[at + 1]])
                at += 1
            else:
                yield self.ids(t)
