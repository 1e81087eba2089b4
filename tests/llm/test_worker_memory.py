"""What a worker keeps between tasks goes when an operator comes that has no use for it."""

import pyarrow as pa
import pytest

from vacantia.llm import common, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_encoders_stay_for_encoding_tasks_only():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})
    words = tokens.encoder(WORD_BPE)
    words.encode_all(["some words"])
    assert list(common.small_batches([batch], 1, common.ENCODERS)) == [batch]
    assert tokens.encoder(WORD_BPE) is words and words.known
    assert list(common.small_batches([batch], 1)) == [batch]
    again = tokens.encoder(WORD_BPE)
    assert again is not words and not again.known
    assert len(list(common.small_frames([batch.to_pandas()], "text"))) == 1
    assert tokens.encoder(WORD_BPE) is not again
