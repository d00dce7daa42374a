import pytest
from pyspark.sql import functions as F

from redactra.operators.recogniser import FAILED, Recogniser, recognise, with_recogniser
from redactra.plans.anonymize import Anonymizer, RecogniserMissing

UNIT = "doc_id long, unit_seq int, text string, context string"


def test_recogniser_finds_names_and_says_what_it_lacks(spark):
    def stub(language):
        """Two capitalised words are a person; a text with the word fail is too much for it."""
        if language == "en":
            raise OSError("no such model")

        import re

        def model(texts):
            if any("fail" in t for t in texts):
                raise RuntimeError
            return [[(m.start(), m.end(), "PER") for m in re.finditer(r"[A-Z][a-z]+ [A-Z][a-z]+", t)] for t in texts]

        return model

    units = spark.createDataFrame([(1, 0, "Ana Soto a@x.org", ""), (1, 1, "for Soto, Ana Soto", ""), (None, 0, "Luis Paz", ""), (2, 0, "fail", ""), (2, 1, "Ana Soto", ""), (3, 0, None, ""), (3, 1, " ", "")], UNIT)
    model = Recogniser(stub, ("es",))
    found = {(r["doc_id"], r["unit_seq"], r["start"], r["label"]) for r in recognise(units, model).collect()}
    assert found == {(1, 0, 0, "PER"), (1, 1, 10, "PER"), (None, 0, 0, "PER"), (2, 0, 0, FAILED), (2, 1, 0, "PER")}
    own = with_recogniser(Anonymizer("soft", "en"), units, model)
    out = {(r["doc_id"], r["unit_seq"]): r["redacted"] for r in own.transform(units).collect()}
    assert out == {(1, 0): "[NAME_1] [EMAIL_1]", (1, 1): "for Soto, [NAME_1]", (None, 0): "[NAME_1]", (2, 0): "fail", (2, 1): "[NAME_1]", (3, 0): None, (3, 1): " "}
    said = own.stats(units).where("doc_id = 1").select("engine", F.to_json("warnings").alias("w")).first()
    assert said["engine"] == "names+regex" and said["w"] == '[{"code":"model_fallback","missing":"en","used":"es"}]'
    assert recognise(units.limit(0), model).count() == 0 and recognise(units, Recogniser(stub, ())).count() == 0
    for none, code in ((None, "recogniser_missing"), (Recogniser(stub, ()), "models_missing")):
        assert with_recogniser(Anonymizer(), units, none).warnings == ({"code": code},)
    with pytest.raises(RecogniserMissing):
        Anonymizer(require_names=True)
