import random
import tracemalloc

import numpy as np
import pytest
from mediaops.llm import token_files
from mediaops.llm.queries import tokenizer_path


@pytest.mark.parametrize("as_text", [True, False])
def test_ids_are_those_of_the_library_whatever_stands_together(as_text):
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = as_text
    draw = random.Random(5)
    pieces = [*"ab'éÀ×÷s,.-!?#_1²\n\n\t  \x00\x1c\x1f\x85\xa0　 东дª", "'s", "'ll", " the", "<|endoftext|>", "ing", "🎉", "x" * 20, "9" * 15]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 14))) for _ in range(4000)]
    encoder = token_files.Encoder(path, as_text)
    for at in range(0, len(texts), 400):
        for text, ids in zip(texts[at:at + 400], encoder.encode_all(texts[at:at + 400]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_what_an_encoder_remembers_does_not_grow_with_the_words():
    encoder = token_files.Encoder(tokenizer_path("byte_bpe_50k.json"))
    draw = np.random.Generator(np.random.PCG64(6))
    tracemalloc.start()
    try:
        for _ in range(10):
            words = draw.choice(np.frombuffer(b"abcdefghilmnoprstu", "S1"), (20_000, 8)).view("S8").ravel()
            encoder.encode_all([" ".join(w.decode() for w in words)])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 5 << 20
