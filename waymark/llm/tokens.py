"""Token ids of whole texts by a public byte-level BPE with word ends, through a cache of words."""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

#: Words that fall apart into letters, single digits and other characters whatever stands around them: Latin-1
#: letters, digits and ASCII punctuation but for the apostrophe (contractions) and < (special tokens).
PLAIN = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!-&(-/:;=-@\[-`{-~]+\Z")
PART = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+")
#: Words kept in a worker's cache; it starts anew beyond that.
CACHE_WORDS = 600_000


class WordEncoder:
    """Ids of white-space separated words; equal to encoding the text at once, as white space always splits."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model = self.tokenizer.model
        shown = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.bytes_shown = {ord(c): shown(c)[0][0] for c in map(chr, range(0xC0, 0x100)) if c.isalpha()}
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.parts[part] = np.array([t.id for t in self.model.tokenize(part.translate(self.bytes_shown))], self.dtype).tobytes()
        return found

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if PLAIN.match(text):
            return b"".join([self._part(p) for p in PART.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text, packed as self.dtype."""
        words, known = text.split(), self.words
        if len(known) + len(self.parts) > CACHE_WORDS:
            known.clear()
            self.parts.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w)
        return b"".join(map(known.__getitem__, words))


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
