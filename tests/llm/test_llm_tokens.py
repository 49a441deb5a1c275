"""Tokenizers of another kind get whole texts, so their ids are right too."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from risklattice.llm.tokens import WordEncoder


@pytest.mark.parametrize("name, pieced", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_the_library_s(name, pieced):
    path = public_tokenizers.path(name)
    encoder, library = WordEncoder(path), Tokenizer.from_file(path)
    assert encoder.pieced is pieced
    texts = ["Hello World, it's  me", None, "", "Ünïcode\ttabs\nlines 12,345", "CamelCase snake_case"]
    ids, sizes = encoder.encode(pa.array(texts))
    wanted = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in wanted] and ids.tolist() == sum(wanted, [])
