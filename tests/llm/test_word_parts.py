"""Parts of plain words go straight to the vocabulary's merges; ids are those of the tokenizers library."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cellgrain.llm.packing import WordEncoder

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_librarys():
    rng, whole = random.Random(5), Tokenizer.from_file(WORDS)
    plain = "aabbstremlld'''SETLDMRVÀéßÿ0129.,;:!?-_/\\[]{}()*&^%$#@~`|\"+= \n\t\r  "
    odd = plain + "<>|\x00\x0b\x85\xa0ªµ×İı中éﬁ٣" + "'"
    texts = ["", " ", "'S it's I'LL we'VE ''re 's,'s", "<|endoftext|>s<|startoftext|>", "a<|endoftext|> b", "<|ENDoftext|>", "</w> x</w>y"]
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for some in (plain, odd) for _ in range(1500)]
    machine = WordEncoder(WORDS)
    found = machine.encode(texts)
    for t, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, np.uint16).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_plain_words_need_no_whole_encoding():
    machine = WordEncoder(WORDS)
    asked = []
    whole = machine._encode
    machine._encode = lambda texts: asked.extend(texts) or whole(texts)
    machine.encode(["Some plain Words, d'été: 12 of them (it's so)!", "one more <odd> word"])
    assert asked == ["<odd>"]
    assert {"words", "'s", "some"} <= machine.words.keys()
