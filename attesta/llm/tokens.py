"""Token ids of whole texts, quickly.

The word tokenizer lower-cases, drops white space and never merges across it, nor between letters and
other characters. So a text's ids are the ids of its white-space separated words in order, and those
of a word like ``Rather,`` are the ids of ``rather`` and of ``,``. Words repeat; each worker keeps
the ids of the words and of the bare letter runs that it has seen as ready little-endian bytes. Either
table is emptied when it reaches ``CACHE_WORDS`` entries, which bounds memory and changes no result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from .common import forget_others, remember

CACHE_WORDS = 700_000
#: Texts whose new words are encoded together, and their characters.
BATCH_TEXTS, BATCH_CHARS = 64, 1_000_000
#: Longer words are encoded, but not remembered.
_LONGEST = 64
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_BEYOND_LATIN = re.compile("[^\x00-\xff]").search

_encoders: dict[str, "WordEncoder"] = {}


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _split(text: str) -> list[str]:
    if "<|" not in text and (text.isascii() or not _BEYOND_LATIN(text)):
        text = text.lower()
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _latin(word: str) -> bool:
    """Only letters that lower-case one by one and that composition leaves alone."""
    return word.isascii() or max(word) < "Ā"


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class WordEncoder:
    """encode_all(texts) gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        def batch(t):
            return getattr(t, "encode_batch_fast", t.encode_batch)

        self._tokenizer = Tokenizer.from_file(path)
        self._batch = batch(self._tokenizer)
        # for text that is runs of lower-case Latin letters with single spaces, there is nothing to normalize or to cut but at spaces
        plain = Tokenizer.from_file(path)
        plain.normalizer = None
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = ["the été über señor abcdefghijk"]
        self._bare = batch(plain) if batch(plain)(probe, add_special_tokens=False)[0].ids == self._tokenizer.encode(probe[0], add_special_tokens=False).ids else self._batch
        self._known: dict[str, bytes] = {}
        # ids that end a run of letters; without such ids runs are encoded one by one
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        self._ends = np.zeros(max(vocabulary.values(), default=0) + 2, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _one_by_one(self, words: list[str]) -> dict[str, bytes]:
        import numpy as np

        return {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(words, self._batch(words, add_special_tokens=False))}

    def _runs(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of runs of lower-case Latin letters, which are one word each to the tokenizer:
        encoded as one text and told apart by the ids that end a word."""
        import numpy as np

        if not runs:
            return {}
        ids = np.array(self._bare([" ".join(runs)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (4 * np.flatnonzero(self._ends[ids]) + 4).tolist()
        if len(ends) != len(runs):
            return self._one_by_one(runs)
        raw = ids.tobytes()
        return {run: raw[a:b] for run, a, b in zip(runs, [0, *ends], ends)}

    def _learn(self, words: set[str]) -> None:
        """Add new words: from their letters and the marks after them, where that is all they are."""
        known, split, other, runs, marks = self._known, [], [], set(), set()
        for w in words:
            run = w.rstrip(_MARKS)
            if run.isalpha() and _latin(run):
                key, mark = run if run.islower() else run.lower(), w[len(run) :]
                split.append((w, key, mark))
                if key not in known:
                    runs.add(key)
                marks.add(mark)
            else:
                other.append(w)
        marks.discard("")
        known.update(self._runs(list(runs)))
        after = self._one_by_one(list(marks))
        after[""] = b""
        for w, key, mark in split:
            known[w] = known[key] + after[mark]
        known.update(self._one_by_one(other))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. Words new to this worker are encoded some texts at a time."""
        at = 0
        while at < len(texts):
            until, chars = at, 0
            while until < len(texts) and until - at < BATCH_TEXTS and (until == at or chars + len(texts[until]) <= BATCH_CHARS):
                chars += len(texts[until])
                until += 1
            split = [_split(t) for t in texts[at:until]]
            known = self._known
            new = set().union(*split).difference(known)
            if new:
                if len(known) + 2 * len(new) > CACHE_WORDS:
                    known.clear()
                    new = set().union(*split)
                self._learn(new)
            for words in split:
                yield b"".join(map(known.__getitem__, words))
            if long := [w for w in new if len(w) > _LONGEST]:
                for w in long:
                    del known[w]
            at = until


def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    forget_others("tokens")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    remember("tokens", _encoders.clear)
    return _encoders[path]
