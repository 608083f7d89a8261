"""Encoding of texts with a public BPE file of the tokenizers library, with a memory of what has been seen.

The files meant here drop white space: a text is cut at white space and every piece between is encoded alone. So a
text's tokens are those of its white-space separated words, one after the other, and a boundary "ASCII white space, then
something else" is stable whatever stands around it: normalisation never composes across it, the split pattern never
spans it, and added tokens hold no white space.

Where the file's normaliser and split pattern are the known ones, texts that hold Latin-1 characters only take a shorter
way: they are lower-cased and cut by the same pattern here, and only the pieces go to the library's BPE model. For
these characters categories, lower case and composition are fixed, so both ways give the same ids. All other texts, and
those with an added token, go to the library word by word.
"""

from __future__ import annotations

import json
import os
import re
import struct
from typing import NamedTuple

import numpy as np

#: White space beyond the four characters below: such texts take the slower split.
_EXOTIC = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WORD = re.compile("[^ \t\n\r]+")
#: Longer pieces aren't remembered.
LONGEST = 128

# The steps of the file for which the shorter way holds, and its pattern over lower-cased Latin-1.
_NORMALISER = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = "\t-\r \x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for the UTF-8 bytes of each Latin-1 character in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


_BYTE_LETTERS = _byte_letters()


class Placed(NamedTuple):
    """Ids of each word or piece, where it starts in the text, and whether that start is a stable boundary."""

    ids: list[bytes]
    starts: np.ndarray
    stable: np.ndarray


class WordEncoder:
    """Broadcast it: the tokenizer is made once per Python worker and the memory of words lives as long as that worker.

    ``remembered`` bounds the memory: two generations of that many words.
    """

    def __init__(self, spec: str, remembered: int = 100_000):
        self.spec, self.remembered = spec, remembered
        self._made = None
        self.added = {t["content"]: t["id"] for t in json.loads(spec).get("added_tokens", [])}
        for token in json.loads(spec).get("added_tokens", []):
            loose = [token[k] for k in ("lstrip", "rstrip", "single_word", "normalized")]
            if re.search(r"\s", token["content"]) or any(loose):
                raise ValueError(f"added token {token['content']!r} may reach across white space")
        both = self.tokenizer.encode("ab \n c!d", add_special_tokens=False).ids
        if both != [i for w in ("ab", "c!d") for i in self.tokenizer.encode(w, add_special_tokens=False).ids]:
            raise ValueError("the tokenizer doesn't drop white space")
        self._made = None

    @classmethod
    def from_file(cls, path: str, **options) -> WordEncoder:
        with open(path, encoding="utf-8") as f:
            return cls(f.read(), **options)

    def __getstate__(self):
        return {"spec": self.spec, "remembered": self.remembered, "added": self.added, "_made": None}

    @staticmethod
    def _known(spec: str) -> bool:
        steps = json.loads(spec)
        normal, cuts = steps.get("normalizer") or {}, steps.get("pre_tokenizer") or {}
        split, *rest = cuts.get("pretokenizers") or [{}]
        return (
            [n["type"] for n in normal.get("normalizers", [])] == _NORMALISER
            and split.get("pattern") == {"Regex": _PATTERN} and split.get("invert") and split.get("behavior") == "Removed"
            and [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        )

    @property
    def tokenizer(self):
        if self._made is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._made = Tokenizer.from_str(self.spec)
            self._made.no_truncation()
            self._made.no_padding()
            self._recent, self._older = {}, {}
            self._short = self._known(self.spec)
            size = self._made.get_vocab_size(with_added_tokens=True)
            self._strings = [self._made.id_to_token(i) or "" for i in range(size)]
        return self._made

    @staticmethod
    def words(text: str) -> list[str]:
        return WORD.findall(text) if _EXOTIC.search(text) else text.split()

    def _plain(self, text: str) -> bool:
        """The shorter way holds."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return self._short and not any(a in text for a in self.added)

    def entries(self, units: list, plain: bool) -> list[bytes]:
        """The ids, 32-bit little-endian, of each word, or of each piece of a text that takes the shorter way."""
        tokenizer = self.tokenizer
        recent, older = self._recent, self._older
        unknown, once = [], {}
        for unit in set(units):
            key = unit if plain else (unit,)
            if key not in recent:
                if key in older:
                    recent[key] = older[key]
                else:
                    unknown.append(unit)
        if plain:
            tokenize = tokenizer.model.tokenize
            encoded = ([t.id for t in tokenize(u.translate(_BYTE_LETTERS))] for u in unknown)
        else:
            encoded = (e.ids for e in tokenizer.encode_batch(unknown, add_special_tokens=False))
        for unit, ids in zip(unknown, encoded):
            (recent if len(unit) <= LONGEST else once)[unit if plain else (unit,)] = struct.pack(f"<{len(ids)}I", *ids)
        keys = units if plain else [(u,) for u in units]
        found = [recent[k] if k in recent else once[k] for k in keys] if once else [recent[k] for k in keys]
        if len(recent) > self.remembered:
            self._older, self._recent = recent, {}
        return found

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of every text."""
        self.tokenizer  # noqa: B018  made on first use
        plain = [self._plain(t) for t in texts]
        units = [_PIECE.findall(t.lower()) if p else self.words(t) for t, p in zip(texts, plain)]
        out: list[bytes] = [b""] * len(texts)
        for way in (True, False):
            which = [i for i, p in enumerate(plain) if p == way]
            entries, at = self.entries([u for i in which for u in units[i]], way), 0
            for i in which:
                out[i] = b"".join(entries[at : at + len(units[i])])
                at += len(units[i])
        return out

    def placed(self, text: str, begin: int, end: int) -> Placed:
        """``text[begin:end]`` taken alone."""
        self.tokenizer  # noqa: B018  made on first use
        part = text[begin:end]
        plain = self._plain(part)
        found = list((_PIECE if plain else WORD).finditer(part.lower() if plain else part))
        starts = np.array([m.start() for m in found], dtype="<i8") + begin
        stable = [p > 0 and text[p - 1] in " \t\n\r" for p in starts.tolist()]
        return Placed(self.entries([m.group() for m in found], plain), starts, np.array(stable, dtype=bool))

    def decode(self, ids: np.ndarray) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)``."""
        tokenizer = self.tokenizer
        if tokenizer.decoder is not None:
            return tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self._strings.__getitem__, ids.tolist()))
