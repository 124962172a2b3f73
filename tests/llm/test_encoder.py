"""The cut-and-memo token encoder against the tokenizer on whole texts."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from precedent.llm.common import TokenEncoder

PATH = "/opt/tokenizers/byte_bpe_50k.json"
WHOLE = Tokenizer.from_file(PATH)
ODD = ["", None, " ", "a", " a", "a ", "a  b", "a\n b", "a \tb c", "\n", "x y", "naïve café — ok", "it's we'll  '",
       "a　 b", "  lead", "  x y", "1 2 33 4", "x" * 5000 + " y", "x y"]


def plain(texts):
    import numpy as np
    return [np.asarray(WHOLE.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_odd_texts():
    assert TokenEncoder(PATH).encode(ODD) == plain(ODD)
    assert TokenEncoder(PATH).encode([]) == []


def test_slices_of_arrow_columns_and_full_generations():
    texts = ODD + [f"w{i} w{i + 1} w{i // 7} tail{i % 3}" for i in range(200)]
    column = pa.array(texts, pa.string())
    encoder = TokenEncoder(PATH, max_words=50)
    found = [ids for at in range(0, len(texts), 30) for ids in encoder.encode(column.slice(at, 30))]
    assert found == plain(texts)


ENCODER = TokenEncoder(PATH, max_words=100)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab '1é\n\t 　Ġ.", max_size=24), max_size=6))
def test_any_text(texts):
    assert ENCODER.encode(texts) == plain(texts)


def test_later_steps_do_not_hold_the_encoder(spark, make):
    import sys

    import pyarrow as pa

    from precedent.llm import op2_toxicity, op5_pack, op9_minhash

    def holders():
        def look(batches):
            held = "_precedent_worker_state" in sys.modules
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([int(held)] * batch.num_rows)], names=["held"])
        return spark.range(0, 64, 1, 64).mapInArrow(look, "held long").groupBy().sum("held").first()[0]

    docs = make([(i, f"some words of text {i} and more of them {i % 7}") for i in range(256)], 64)
    for step in (lambda: op9_minhash.sketch(docs), lambda: op2_toxicity.score(docs, ({}, None))):
        assert op5_pack.pack(docs, PATH).count() == 256
        before = holders()
        assert before > 0
        step().write.format("noop").mode("overwrite").save()
        assert holders() < before / 2
