"""Ids of the cached encoder against the tokenizer itself, on letters and marks that its rules treat apart."""

import random

import numpy as np

from oddspark.llm import tokens
from tests.llm.test_operators import encoded


def test_ids_are_the_tokenizers():
    r = random.Random(6)
    alphabet = list("aZéßİıñÑ$&.,!?'’̇́日本½²ﬁǅΣς0 7_-\n\t") + ["  ", "don't", "ẞ", "😀", "İ$", "İ̇."]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(3000)] + ["İ$", "xİ!", "", " "]
    own = tokens.Encoder(tokens.default_path(), 4)
    for text, ids in zip(texts, encoded(texts)):
        assert np.frombuffer(own.encode(text), own.kind).tolist() == ids, repr(text)
