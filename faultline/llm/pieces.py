"""Texts cut before spaces, for tokenizers that never join what such a cut parts.

A text is cut before each space that follows something other than white space.
No word of a byte-level pattern and no piece of a vocabulary whose space marks
stand in front reaches over such a cut, so the codes of the parts, one after
another, are the codes of the text. Parts recur, hence each is coded once while
it is remembered.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import regex

from faultline.llm.bpe import PATTERN, byte_letters
from faultline.llm.common import WordCache

CUT = re.compile(r"(?<=\S)(?= )")
#: Longer parts are coded each time: what a worker remembers stays bounded.
LONGEST = 120
#: Characters of texts whose unknown parts are coded together.
TOGETHER = 1 << 21
#: Words that a worker process remembers, in each of two generations.
CACHE_WORDS = 100_000
#: The first code point of scripts that pattern libraries may not know alike.
YOUNGER = "\u0500"
#: Signs that are a word of their own after letters.
SIGNS = frozenset('.,;:!?)"]')


def _recurs(part: str) -> bool:
    """A part that may be remembered: not too long, and the next space after it is a cut."""
    return part != "" and len(part) <= LONGEST and not part[-1].isspace()


class Pieces:
    """Records of the parts of texts. ``code`` turns parts, each to be read with
    one space before it, into records; two generations of at most ``limit``
    records each are remembered. The unknown parts of ``TOGETHER`` characters of
    texts are coded in one call."""

    def __init__(self, code: Callable[[list[str]], list], limit: int):
        self.code, self.limit = code, limit
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, texts: list[str]) -> Iterator[list]:
        """Records of each text read with a space before it."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[list]:
        young, old = self.young, self.old
        parted = [text.split(" ") for text in texts]
        unknown = set().union(*parted).difference(young)
        # what stands before a space that is no cut
        open_ended = {p for p in unknown if not p or p[-1].isspace()}
        if open_ended:
            for k, parts in enumerate(parted):
                if not open_ended.isdisjoint(parts):
                    parted[k] = [s[1:] for s in CUT.split(" " + texts[k])]
                    unknown.update(parted[k])
            unknown = unknown.intersection(set().union(*parted)).difference(young)
        for p in unknown & old.keys():
            young[p] = old[p]
            unknown.remove(p)
        once = {}
        ordered = list(unknown)
        records = self.code(ordered) if ordered else []
        if open_ended or max(map(len, ordered), default=0) > LONGEST:
            for p, record in zip(ordered, records, strict=True):
                (young if _recurs(p) else once)[p] = record
        else:
            young.update(zip(ordered, records, strict=True))
        for parts in parted:
            if once and not once.keys().isdisjoint(parts):
                yield [young[p] if p in young else once[p] for p in parts]
            else:
                yield list(map(young.__getitem__, parts))
        if len(young) > self.limit:
            self.old, self.young = young, {}


class PartIds:
    """Ids of parts of texts by a tokenizer file of the tokenizers library, without added special tokens.

    A part is split into words here where the pattern leaves no doubt (letters,
    letters and one sign) or by the pattern itself, and the words not met before are coded
    by the tokenizer's model. Parts with special tokens or with letters of younger
    scripts, which pattern libraries may class differently, are coded whole by the library.
    ``by_part`` tells whether texts may be coded by their parts at all.
    """

    def __init__(self, source: str, width: str = "<u4", special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.width = Tokenizer.from_str(source), width
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = not special
        spec = json.loads(source)
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"] if special else []
        plain = all(" " not in t["content"] and not t["content"][:1].isalpha() and not (
            t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        self.by_part = (plain and not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre["use_regex"]
                        and not pre["add_prefix_space"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        self.word, self.letters, self.model = regex.compile(PATTERN), dict(enumerate(byte_letters())), self.tokenizer.model
        self.words = WordCache(self._code_word, CACHE_WORDS)
        self.blank, self.kind = self.letters[32], "H" if width == "<u2" else "I"

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _code_word(self, word: str) -> bytes:
        if word[0] == " " and word.isascii() and word[1:].isalpha():
            spelt = self.blank + word[1:]
        else:
            spelt = word.encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def __call__(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, each read with one space before it."""
        out, others, special, word, findall = [], [], self.special, self.words.young, self.word.findall
        for p in parts:
            if p.isascii() or max(p) < YOUNGER:
                if p.isalpha():
                    out.append(word[" " + p])
                    continue
                if p[-1:] in SIGNS and p[:-1].isalpha():
                    out.append(word[" " + p[:-1]] + word[p[-1]])
                    continue
                if not (special and special.search(p)):
                    out.append(b"".join([word[w] for w in findall(" " + p)]))
                    continue
            others.append(len(out))
            out.append(b"")
        if others:
            for k, ids in zip(others, self.whole([" " + parts[k] for k in others]), strict=True):
                out[k] = ids
        self.words.turn()
        return out
