"""Token ids of whole texts by a public tokenizer file, with a cache of words.

A text is taken apart where no token can span two parts: before a space that
follows other characters. Natural text repeats its words, so the texts of a
batch are split in Arrow, each distinct part is looked up once, and most are
found in a cache. A missed part is taken apart into runs of letters, digits and
marks as the tokenizer's own pattern does, and each run is put to the library's
model. Whatever has another form goes to the library whole. The result equals
the library's on the whole text, which the tests hold it to.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache as once

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Entries of each of the two generations of the cache, and its longest key.
GENERATION, LONGEST = 1 << 19, 64
#: Bytes of texts, if there are several, and number of texts that are split at once.
SPLIT_BYTES, SPLIT_TEXTS = 1 << 23, 8192
#: Separators that Python, but not the tokenizers, takes for white space.
_ODD = re.compile("[\x1c-\x1f]")
#: Letters and marks on which Python and the tokenizers' pattern surely agree; apostrophes begin contractions.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
#: What keeps a text from being split at each space, or from being put in lower case before.
_SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNEVEN, _FOREIGN = rf"[\x1c-\x1f]|[{_SPACES}] |[{_SPACES}]$", r"[\x1c-\x1f]|[^\x00-\xff]"
#: Stands before a run of a text that follows no space; texts that hold it themselves are not split.
_NEXT = "\x1e"
_BORDERS = (rf"([{_LETTERS}])([{_MARKS}]+)", r"\1 %s\2"), (rf"([{_MARKS}])([{_LETTERS}]+)", r"\1 %s\2"), (rf"([{_LETTERS}{_MARKS}])\n([{_LETTERS}{_MARKS}])", "\\1 %s\n %s\\2")
_PLAIN_LINES = re.compile(rf"[{_LETTERS}{_MARKS}0-9]+(?:\n[{_LETTERS}{_MARKS}0-9]+)*").fullmatch
_PLAIN_WORD = re.compile(rf"[{_LETTERS}{_MARKS}0-9]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Gap(Exception):
    """White space before a space: the text cannot be cut at each space."""


class _Runs(dict):
    """Maps a run of letters, digits or marks that follows no space to its ids."""

    def __init__(self, ids_of):
        super().__init__()
        self._ids_of = ids_of

    def __missing__(self, run: str) -> bytes:
        if len(self) >= GENERATION:
            self.clear()
        ids = self[run] = self._ids_of(run)
        return ids


class Encoder(dict):
    """Maps a part of a text to its ids, little-endian unsigned 32-bit.

    A part is what stands between white space for a model that drops it, and
    what follows a space, without it, for one whose words own the space.
    """

    def __init__(self, path: str):
        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        # With a normalizer that drops white space words stand alone and in lower case.
        self._lower = self._tokenizer.normalizer is not None
        self._letters = _byte_letters()
        self._space = "" if self._lower else self._letters[32]
        self._plain = _PLAIN_WORD if self._lower else _PLAIN_LINES
        self._split = re.compile(rf"[{_LETTERS}]+|[{_MARKS}]+|[0-9]|\n" if self._lower else rf"[{_LETTERS}]+|[{_MARKS}]+|[0-9]+|\n").findall
        self._tokens = self._tokenizer.model.tokenize
        self._runs = self if self._lower else _Runs(self._run)
        self._old: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empties the cache, so that a worker that waits for another kind of task holds no words."""
        self.clear()
        self._old.clear()
        if self._runs is not self:
            self._runs.clear()
        pa.default_memory_pool().release_unused()

    def vocabulary(self) -> int:
        """One more than the largest id."""
        return max(self._tokenizer.get_vocab().values(), default=0) + 1

    def _whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: str, space: str = "") -> bytes:
        """Ids of one run of letters, digits or marks, or of a line break."""
        coded = run if run.isascii() and run != "\n" else run.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._tokens(space + coded)]).tobytes()

    def _fresh(self, part: str) -> bytes:
        if part[:1] == _NEXT:
            return self._alone(part[1:])
        if part.isascii() and part.isalpha() and len(part) <= LONGEST:
            return self._run(part.lower() if self._lower else part, self._space)
        if len(part) > LONGEST or not self._plain(part):
            return self._whole(part if self._lower else " " + part)
        if self._lower:
            part = part.lower()
        first, *others = self._split(part)
        if not others:
            return self._run(part, self._space)
        return self[first] + b"".join(map(self._runs.__getitem__, others))

    def __missing__(self, part: str) -> bytes:
        if not self._lower and (not part or part[-1].isspace() and part[0] != _NEXT):
            raise _Gap
        ids = self._old.pop(part, None)
        if ids is None:
            ids = self._fresh(part)
        if len(part) <= LONGEST:
            if len(self) >= GENERATION:
                self._old = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def _alone(self, part: str) -> bytes:
        """Ids of a part that follows no space."""
        if not part:
            return b""
        if part.isascii() and part.isalpha() and len(part) <= LONGEST:
            return self._run(part)
        if len(part) > LONGEST or not self._plain(part):
            return self._whole(part)
        return b"".join(map(self._runs.__getitem__, self._split(part)))

    def _spaced(self, part: str) -> bytes:
        """Ids of a stretch that may begin with any white space."""
        if part[0] == " " and not part[-1].isspace() and not part[1].isspace():
            return self[part[1:]]
        return self._alone(part)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text; null gives none."""
        if not text:
            return b""
        if _ODD.search(text):
            return self._whole(text)
        if self._lower:
            try:  # up to U+00FF lower case is the same, letter for letter, for Python and the tokenizers
                text.encode("latin-1")
            except UnicodeEncodeError:
                return b"".join(map(self.__getitem__, text.split()))
            return b"".join(map(self.__getitem__, text.lower().split()))
        body = text.rstrip()
        parts = body.split(" ")
        first = self._alone(parts.pop(0))
        tail = self._whole(text[len(body) :]) if len(body) < len(text) else b""
        try:
            return first + b"".join(map(self.__getitem__, parts)) + tail
        except _Gap:
            return b"".join(map(self._spaced, re.findall(r"\s*\S+", body))) + tail

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text of an Arrow array of strings, in order; null gives none."""
        for part in groups(pc.fill_null(texts, "")):
            odd = pc.match_substring_regex(part, _FOREIGN if self._lower else _UNEVEN)
            even = iter(self._split_all(part.filter(pc.invert(odd))))
            if pc.any(odd).as_py():
                yield from (self.encode(t) if is_odd else next(even) for t, is_odd in zip(part.to_pylist(), odd.to_pylist(), strict=True))
            else:
                yield from even

    def _split_all(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        if self._lower:
            texts = pc.utf8_lower(texts)
            for border, apart in _BORDERS[:2]:
                texts = pc.replace_substring_regex(texts, border, apart.replace("%s", ""))
            lists = pc.utf8_split_whitespace(texts)
        else:
            for border, apart in _BORDERS:
                texts = pc.replace_substring_regex(texts, border, apart.replace("%s", _NEXT))
            lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        at = np.asarray(words.indices)
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads: list[bytes] = []
        if not self._lower:  # what begins a text follows no space; it is set apart as a part without ids
            heads = [self._alone(known[i]) for i in at[bounds[:-1]].tolist()]
            at = at.copy()
            at[bounds[:-1]] = len(known)
            only_heads = np.bincount(at, minlength=len(known) + 1)[:-1] == 0
            ids = [b"" if alone else self[w] for w, alone in zip(known, only_heads.tolist(), strict=True)]
            ids.append(b"")
        else:
            ids = list(map(self.__getitem__, known))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(sizes) - sizes
        each = sizes[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        data = table[np.repeat(starts[at] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[bounds]).tolist()
        bodies = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return [h + b for h, b in zip(heads, bodies, strict=True)] if heads else bodies


def groups(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of at most SPLIT_TEXTS texts and, if there are several, of SPLIT_BYTES bytes."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + SPLIT_BYTES, "right"))), at + SPLIT_TEXTS)
        yield texts.slice(at, to - at)
        at = to


@once
def encoder(path: str) -> Encoder:
    """One encoder per process and file; Python workers are reused between tasks."""
    return Encoder(path)
