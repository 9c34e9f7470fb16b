"""Token ids of whole texts through the tokenizers library, with a bounded cache of chunks that encode independently.

A byte-pair encoder works on the pieces its pre-tokenizer cuts; where a text is cut at a place that is a piece's end in any
context, the ids of the whole are those of the parts one after the other. Two such places are used: before a space that
follows a visible character, and between a Latin letter and ASCII punctuation. Everything else, and texts that hold a
special token's string, is handed to the library in longer parts or whole.
"""

from __future__ import annotations

import functools
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

_BEFORE_SPACE = re.compile(r"(?<=[!-~])(?= )")
# Without U+0130, whose lower case ends in a combining mark that joins the punctuation after it.
_INSIDE = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-įı-ɏ])(?=[!-/:-@\[-`{-~\n])|(?<=[!-~])(?=\n)")
#: Punctuation at the end of a word, and a line's end between two visible characters: both are pieces of their own. There
#: texts are cut before they are split into words, so that words and line starts are not told apart by what stands before or
#: after; the mark tells that no space stood there.
_MARK = "\0"
_MARKED = re.compile(
    r"[,.;:!?\n](?:(?<=[A-Za-zÀ-ÖØ-öø-įı-ɏ][,.;:!?])(?=[ \n])|(?<=[!-~A-Za-zÀ-ÖØ-öø-įı-ɏ]\n)(?=[!-~A-Za-zÀ-ÖØ-öø-įı-ɏ]))"
)
_AFTER = rf" {_MARK}\g<0>"

#: Words of Latin letters alone: after a space each is one piece in every one of the byte-pair encoders' pre-tokenizers.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
_TOGETHER = 300  # words handed to the library at once
_WAITING = 500_000  # words of the texts that are encoded together

_TAIL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Open(Exception):
    """A word whose end is not certainly the end of a piece."""


class Generations(dict):
    """A cache of bounded size: when the young generation is full it becomes the old one, whose used entries come back."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def held(self, keys: list) -> list:
        """What the cache holds of ``keys``, None for the rest."""
        values = list(map(self.get, keys))
        for at in [k for k, value in enumerate(values) if value is None]:
            value = self.old.get(keys[at])
            if value is not None:
                self.put(keys[at], value)
                values[at] = value
        return values


class CachedEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. A null text counts as empty."""

    def __init__(self, path: str, *, words: int = 250_000, parts: int = 30_000):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # The mark of a word in the vocabulary: an end-of-word suffix, or the byte encoder's character for a space before it.
        suffix = self.library.model.end_of_word_suffix
        self.at_end = bool(suffix)
        vocabulary = self.library.get_vocab()
        self.edge = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.edge[[i for token, i in vocabulary.items() if (token.endswith(suffix) if suffix else token.startswith("Ġ"))]] = True
        self.parts = Generations(self._ids, parts)
        self.words = Generations(self._word, words)

    def _ids(self, text: str) -> bytes:
        ids = array("I", self.library.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _split(self, text: str) -> bytes:
        return b"".join([self.parts[p] for p in _INSIDE.split(text)])

    def _after(self, word: str) -> bytes:
        """A mark, the character it stands before and the rest of the word."""
        return self.parts[word[1]] + (self._split(word[2:]) if len(word) > 2 else b"")

    def _word(self, word: str) -> bytes:
        """A word that stands after a space and before another one."""
        if not word or not ("!" <= word[-1] <= "~" or word[-1].isalnum()):
            raise _Open
        if word[0] == _MARK:
            return self._after(word)
        core = word.rstrip(_TAIL)
        if core.isalpha() and "İ" not in core:
            if len(core) == len(word):
                return self._ids(" " + word)
            return self.words[core] + self.parts[word[len(core) :]]
        return self._split(" " + word)

    def _learn(self, words: list[str]) -> None:
        """Put plain words' ids into the cache, many with one call: a call costs more than a word.

        The ids that begin or end a word tell the words apart. If there are not as many as words, the words are left to be
        encoded singly.
        """
        for low in range(0, len(words), _TOGETHER):
            some = words[low : low + _TOGETHER]
            text = " " + " ".join(some)
            if any(s in text for s in self.special):
                continue
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(some) or not edges.size or edges[-1 if self.at_end else 0] != (len(ids) - 1 if self.at_end else 0):
                continue
            bounds = [0, *(4 * (edges + 1)).tolist()] if self.at_end else [*(4 * edges).tolist(), 4 * len(ids)]
            found = ids.tobytes()
            for word, begin, end in zip(some, bounds, bounds[1:]):
                self.words.put(word, found[begin:end])

    def _learn_parts(self, parts: list[str]) -> None:
        """Put parts' ids into their cache with one call."""
        for part, found in zip(parts, self.library.encode_batch_fast(parts, add_special_tokens=False)):
            self.parts.put(part, np.array(found.ids, "<u4").tobytes())

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as ``encode`` gives them. Texts (of about ``_WAITING`` words) are split and joined together, each
        distinct word of theirs is looked up once, and words that no cache holds are encoded together."""
        found: list[bytes | None] = [None] * len(texts)
        waiting: list[int] = []
        held = 0
        for at, text in enumerate(texts):
            if not text or " " not in text or _MARK in text or any(s in text for s in self.special):
                found[at] = self.encode(text)
                continue
            waiting.append(at)
            held += text.count(" ") + 1
            if held > _WAITING:
                self._finish(waiting, texts, found)
                waiting, held = [], 0
        if waiting:
            self._finish(waiting, texts, found)
        return found

    def _finish(self, waiting: list[int], texts: list[str | None], found: list[bytes | None]) -> None:
        marked = pa.array([_MARKED.sub(_AFTER, texts[at]) for at in waiting], pa.large_string())
        split = pc.split_pattern(marked, " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # The first and the last word stand otherwise than those between: they get codes of their own.
        first, last = bounds[:-1], bounds[1:] - 1
        begins, ends = [words[c] for c in codes[first].tolist()], [words[c] for c in codes[last].tolist()]
        codes[first] = len(words) + np.arange(len(waiting))
        codes[last] = len(words) + len(waiting) + np.arange(len(waiting))
        pieces = self.words.held(words)
        lacking = [k for k, piece in enumerate(pieces) if piece is None]
        self._learn_all([words[k] for k in lacking], begins, ends)
        for at in lacking:
            try:
                pieces[at] = self.words[words[at]]
            except _Open:
                pass
        pieces += [self._split(w) if w and ("!" <= w[-1] <= "~" or w[-1].isalnum()) else None for w in begins]
        pieces += [self._after(w) if w[:1] == _MARK else self._split(" " + w) for w in ends]
        joined = pa.array(pieces, pa.large_binary()).take(pa.array(codes))
        places = np.frombuffer(joined.buffers()[1], np.int64)[bounds].tolist()
        ids = memoryview(joined.buffers()[2] or b"")
        opened = np.logical_or.reduceat(joined.is_null().to_numpy(zero_copy_only=False), first).tolist()
        for at, fails, begin, end in zip(waiting, opened, places, places[1:]):
            found[at] = b"".join([self._split(p) for p in _BEFORE_SPACE.split(texts[at])]) if fails else bytes(ids[begin:end])

    def _learn_all(self, words: list[str], begins: list[str], ends: list[str]) -> None:
        """Encode together what the caches lack for ``words`` that stand between others, and for texts' first and last ones."""
        cores = [w.rstrip(_TAIL) for w in words]
        plain = [c for c in dict.fromkeys(cores) if _PLAIN.fullmatch(c)]
        self._learn([c for c, ids in zip(plain, self.words.held(plain)) if ids is None])
        pieces = [w[2:] if w[0] == _MARK else " " + w for w, c in zip(words, cores) if w and not c.isalpha()]
        pieces += begins + [w[2:] if w[:1] == _MARK else " " + w for w in ends]
        parts = list({p for w in pieces for p in _INSIDE.split(w)})
        self._learn_parts([p for p, ids in zip(parts, self.parts.held(parts)) if ids is None])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._ids(text)
        if _MARK in text:
            return b"".join([self._split(p) for p in _BEFORE_SPACE.split(text)])
        first, *rest = text.split(" ")
        if not rest:
            return self._split(text)
        last = rest.pop()
        try:
            if not first or not ("!" <= first[-1] <= "~" or first[-1].isalnum()):
                raise _Open
            words = self.words
            return b"".join([self._split(first), *[words[w] for w in rest], self._split(" " + last)])
        except _Open:
            return b"".join([self._split(p) for p in _BEFORE_SPACE.split(text)])


#: Entries of the word and part caches: a small pair, and one that trades a few hundred MB of a worker for time.
SMALL, LARGE = (250_000, 30_000), (500_000, 300_000)


@functools.lru_cache(maxsize=4)
def encoder(path: str, cache: tuple[int, int] = SMALL) -> CachedEncoder:
    """One encoder per Python worker, tokenizer and cache size. A task has one core, so the library starts no threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    words, parts = cache
    return CachedEncoder(path, words=words, parts=parts)
