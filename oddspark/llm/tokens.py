"""Token ids of texts with a public tokenizer file.

White space never joins two tokens in the tokenizers used here (they drop it), so
a text is cut at ASCII white space and each distinct chunk is encoded once per
worker by the tokenizer itself; the ids of a text are those of its chunks in
order. A chunk of letters with punctuation after it is the ids of the letters and
those of the punctuation. The memory is bounded: a full memory becomes the old one,
from which what is met again is taken over, and the old one before it is forgotten.
"""

from __future__ import annotations

import os
import re

#: Chunks, and words without their punctuation, in each of the two memories of a worker.
CACHE_CHUNKS = 300_000
_LETTERS_THEN_MARKS = re.compile(rb"([A-Za-z\x80-\xff]+)([.,!?;:%&$#*]*)")


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as little-endian unsigned integers of ``width`` bytes."""

    _kept: dict[tuple[str, int], "Encoder"] = {}

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kind = {2: "<u2", 4: "<u4"}[width]
        self.cache: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.old_cache: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 + self.tokenizer.get_vocab_size(), bool)
        self.ends[[at for token, at in vocabulary.items() if token.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str, width: int = 4) -> "Encoder":
        """One encoder per worker process, so that tasks share what it remembers."""
        if (path, width) not in cls._kept:
            cls._kept[path, width] = cls(path, width)
        return cls._kept[path, width]

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        import numpy as np

        found = self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _learn_words(self, words: list[bytes]) -> None:
        """Ids of words made of letters only; encoded as one line, where the tokenizer marks the ends of words."""
        import numpy as np

        ids = np.frombuffer(self._plain([b" ".join(words)])[0], self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            self.words.update(zip(words, self._plain(words)))
            return
        raw, width = ids.tobytes(), ids.itemsize
        at = [0, *(ends * width).tolist()]
        self.words.update((w, raw[a:b]) for w, a, b in zip(words, at, at[1:]))

    def _learn(self, chunks: list[bytes]) -> None:
        if len(self.words) + len(chunks) > CACHE_CHUNKS:
            self.words, self.old_words = {}, self.words
        own, old = self.words, self.old_words
        whole, split, new = [], [], set()
        for chunk in chunks:
            found = _LETTERS_THEN_MARKS.fullmatch(chunk)
            # a letter whose lower case holds a mark is not told apart from marks that follow
            if found and (letters := found[1].decode("utf-8")).isalpha() and letters.lower().isalpha():
                word = found[1].lower()
                split.append((chunk, word, found[2]))
                if word not in own:
                    if word in old:
                        own[word] = old[word]
                    else:
                        new.add(word)
                if found[2] and found[2] not in self.cache:
                    self.cache[found[2]] = self._plain([found[2]])[0]
            else:
                whole.append(chunk)
        if new:
            self._learn_words(list(new))
        for chunk, word, marks in split:
            self.cache[chunk] = own[word] + self.cache[marks] if marks else own[word]
        if whole:
            self.cache.update(zip(whole, self._plain(whole)))

    def encode(self, text: str) -> bytes:
        chunks = text.encode("utf-8").split()
        cache = self.cache
        missing = [c for c in set(chunks) if c not in cache]
        if missing:
            if len(cache) + len(missing) > CACHE_CHUNKS:
                self.old_cache, self.cache = cache, {}
                cache, missing = self.cache, list(set(chunks))
            old = self.old_cache
            known = {c: old[c] for c in missing if c in old}
            cache.update(known)
            self._learn([c for c in missing if c not in known])
        return b"".join([cache[c] for c in chunks])
