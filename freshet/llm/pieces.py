"""Whole-text encoding with the tokenizers library, remembering the pieces met before.

A byte-pair tokenizer splits a text into pre-tokens and merges inside each, so a text can be cut
between pre-tokens, each part encoded by the library once, and the ids joined: the same
ids as for the whole text.  Cuts are made where no pre-token can reach across:

* at a single space or line feed between two visible characters.  Byte-level tokenizers join the
  space to what follows and make the line feed a pre-token; tokenizers that drop white space lose both.
* between a letter and one closing mark at the end of such a part (letters up to U+012F, which no
  normalizer turns into a letter with a mark behind it).
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from ._common import only, remembers

#: parts remembered in each of two generations; longer parts are never kept
KEPT, LONGEST = 500_000, 48
#: what some library may count as white space and Python does not
_CUT, _LINE = (re.compile(f"(?<=[^\\s\\u180e\\u200b\\u2060\\ufeff]){c}(?=[^\\s\\u180e\\u200b\\u2060\\ufeff])") for c in " \n")
#: white space, or nearly, at which a text is not simply lines of words with single spaces
_ODD_ASCII = ["  ", " \n", "\n ", "\n\n", *"\t\r\v\f\x1c\x1d\x1e\x1f"]
_ODD = [*_ODD_ASCII, *map(chr, [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F,
                                0x2060, 0x3000, 0xFEFF])]
#: the space as byte-level vocabularies spell it, and words of a line of words to encode
SPACE, LINE = "\u0120", 500
#: stands before the key of a part that no space came before
HEAD = "\0"
_MARKS = frozenset(".,;:!?")

_encoders: dict[str, "PieceEncoder"] = {}
remembers("pieces", _encoders.clear)


def encoder(path: str) -> "PieceEncoder":
    """The worker's encoder for a tokenizer file; one is kept."""
    only("pieces")
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("truncation") or spec.get("padding"):
            raise ValueError(f"{path} is no plain byte-pair tokenizer")
        lowered = "Lowercase" in json.dumps(spec.get("normalizer"))
        #: lower-casing A-Z beforehand changes nothing and makes more parts alike
        self.lowered = lowered
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        #: which ids begin with a space, where the tokenizer keeps spaces before words
        self.spaced = None
        if not lowered and not any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", ())):
            spaced = np.zeros(size, bool)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                spaced[i] = token.startswith(SPACE)
            self.spaced = spaced if spaced.any() else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text behind each id of a byte-level vocabulary, one character a byte."""
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            out[i] = len(token)
        return out

    def _joined(self, keys: list[str]) -> list[bytes] | None:
        """Ids of words, behind a space each, encoded as lines of many; None if they cannot be told apart."""
        lines = [" " + " ".join(keys[i:i + LINE]) for i in range(0, len(keys), LINE)]
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(
            lines, add_special_tokens=False)])
        first = np.flatnonzero(self.spaced[ids])
        if len(first) != len(keys):
            return None
        data, size = ids.tobytes(), ids.itemsize
        cuts = [*(first * size).tolist(), len(data)]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _library(self, keys: list[str]) -> list[bytes]:
        if self.spaced is not None:
            # without a space inside, only a word's first id begins with one
            words = [k for k in keys if k.isalnum() or k.isascii() and k.isprintable() and " " not in k]
            found = self._joined(words) if len(words) > 1 else None
            if found is not None:
                known = dict(zip(words, found))
                others = [k for k in keys if k not in known]
                known.update(zip(others, self._each(others)))
                return [known[k] for k in keys]
        return self._each(keys)

    def _each(self, keys: list[str]) -> list[bytes]:
        parts = keys if self.lowered else [k[1:] if k[0] == HEAD else " " + k for k in keys]
        return [np.array(e.ids, self.dtype).tobytes()
                for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, keys: set[str]) -> dict[str, bytes]:
        """Ids of parts not met before."""
        mark = "" if self.lowered else HEAD
        halves = {k: (k[:-1], mark + k[-1]) for k in keys
                  if len(k) > 2 and k[-1] in _MARKS and k[-2].isalpha() and k[-2] < "\u0130"}
        single = [k for k in keys if k not in halves]
        for pair in halves.values():
            single += [h for h in pair if h not in self.young and h not in self.old]
        single = list(dict.fromkeys(single))
        found = dict(zip(single, self._library(single)))
        known = lambda h: found.get(h) or self.young.get(h) or self.old.get(h) or b""
        for key, (word, closing) in halves.items():
            found[key] = known(word) + known(closing)
        return found

    def _parts(self, text: str) -> list[str]:
        """Keys of the text's parts: a part that stood behind a space as it is, others behind ``HEAD``."""
        if self.lowered:
            if "<|" not in text:  # lower-casing could make a special token
                text = text.encode().lower().decode()
            return [p for p in text.replace("\n", " ").split(" ") if p]
        if HEAD in text:
            return [HEAD + text]
        regular = not any(map(text.__contains__, _ODD_ASCII if text.isascii() else _ODD)) \
            and text[0] not in " \n" and text[-1] not in " \n"
        parts: list[str] = []
        for line in text.split("\n") if regular else _LINE.split(text):
            own = line.split(" ") if regular else _CUT.split(line)
            own[0] = HEAD + own[0]
            parts += own
            parts.append(HEAD + "\n")
        parts.pop()
        return parts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; NULL and empty texts have none."""
        split = [self._parts(text) if text else [] for text in texts]
        unseen = set().union(*split).difference(self.young)
        again = {k: self.old[k] for k in unseen if k in self.old}
        now = {**again, **self._learn(unseen.difference(again))} if unseen else {}
        if len(self.young) + len(now) > KEPT:
            self.old, self.young = self.young, {}
            lookup = {**self.old, **now}
        else:
            lookup = None
        self.young.update((k, v) for k, v in now.items() if len(k) <= LONGEST)
        if lookup is None:
            extra = {k: v for k, v in now.items() if len(k) > LONGEST}
            lookup = {**self.young, **extra} if extra else self.young
        get = lookup.__getitem__
        return [np.frombuffer(b"".join(map(get, parts)), self.dtype) for parts in split]
