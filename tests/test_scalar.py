import numpy as np
import math
import hashlib
import json

from pyspark.sql import functions as F

from panelstat.functions import scalar as S
from panelstat.functions import tails


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or ["id"])
    return df.select(expr.alias("x")).first().x


def test_participant_id(spark):
    want = "participant_" + hashlib.sha256("jo doe|jo@x.org".encode()).hexdigest()[:8]
    assert one(spark, S.participant_id("n", "e"), n=" Jo Doe ", e="JO@X.org ") == want
    assert one(spark, S.valid_participant_id("p"), p=want) and not one(spark, S.valid_participant_id("p"), p="participant_1")


def test_case_uuid(spark):
    u = "0075B71F-ec8f-4884-8297-5119de2e4b0e"
    assert one(spark, S.extract_case_uuid("h"), h=f" {u} - A person") == u.lower()
    assert one(spark, S.extract_case_uuid("h"), h="Name") is None
    assert one(spark, S.is_uuid4("h"), h=u) and not one(spark, S.is_uuid4("h"), h=u.replace("-4884", "-1884"))
    assert one(spark, S.case_id_from_filename("h"), h=f"case_{u}_0123456789ab.json") == u


def test_timestamps(spark):
    for text in ("2026-01-12 07:32:34", "01/12/2026 07:32:34", "2026-01-12T07:32:34", "2026-01-12T07:32:34Z"):
        assert str(one(spark, S.parse_timestamp("t"), t=text)) == "2026-01-12 07:32:34"
    assert str(one(spark, S.parse_timestamp("t"), t="01/12/2026 07:32")) == "2026-01-12 07:32:00"
    assert one(spark, S.parse_timestamp("t"), t="yesterday") is None


def test_content_hash_of_any_text(spark):
    texts = ['plain "quoted" \\ text', "naïve café\n\ttab", "emoji \U0001f600 end", "\x01\x1f \x7f control", "C:\\u00E9\\U \\\\u00AB", "ÉÀ at the start", ""]
    for t in texts:
        doc = {"vignette": t, "choice_1": {"choice": t, "autonomy": "neutral"}, "choice_2": {"choice": "b", "autonomy": "promotes"}}
        want = hashlib.sha256(json.dumps(doc, sort_keys=True).encode()).hexdigest()[:12]
        one_, two = {"choice": F.col("t"), "autonomy": F.lit("neutral")}, {"choice": F.lit("b"), "autonomy": F.lit("promotes")}
        assert one(spark, S.content_hash("t", one_, two), t=t) == want


def test_options_as_text_or_object(spark):
    df = spark.sql("""select parse_json('{"c": {"choice": "A", "autonomy": "neutral"}}') as a, parse_json('{"c": "B"}') as b""")
    got = df.select(
        S.option_text(F.try_variant_get("a", "$.c", "variant")).alias("x"), S.option_text(F.try_variant_get("b", "$.c", "variant")).alias("y")
    ).first()
    assert (got.x, got.y) == ("A", "B")
    assert one(spark, S.case_text("v", F.lit("a"), F.lit(None).cast("string")), v="V") == "V\n\nChoice 1: a\n\nChoice 2: "


def test_labels(spark):
    assert one(spark, S.display_name("r", {"p/m": "M"}), r="p/m") == "M"
    assert one(spark, S.display_name("r", {"m": "M"}), r="q/m") == "M"
    assert one(spark, S.display_name("r", {}), r="human/participant_ab12cd34") == "Physician AB12"
    assert one(spark, S.display_name("r", {}), r="a/b/c") == "c"
    assert one(spark, S.preview("t", 3), t="abcd") == "abc..." and one(spark, S.preview("t", 4), t="abcd") == "abcd"
    assert one(spark, S.similarity_pct("s"), s=-0.659) == -65
    assert one(spark, S.rater_slug("r"), r="a/b") == "a-b"


def test_review_decisions(spark):
    for word, want in ((" Approved", "approve"), ("NO", "reject"), ("", "skip"), ("n/a", "skip"), ("later", "unknown")):
        assert one(spark, S.normalise_review_decision("w"), w=word) == want


def test_bad_tag_is_an_error(spark):
    import pytest

    assert one(spark, S.align("t"), t="violates") == -1
    with pytest.raises(Exception, match="invalid tag"):
        one(spark, S.align("t"), t="both")


def test_tail_probabilities():
    # tabulated quantiles
    assert abs(tails.chi2_3_sf(7.814727903251179)[0] - 0.05) < 1e-9
    x = np.linspace(0, 12, 500)
    assert np.allclose(tails._erfc(x), [math.erfc(v) for v in x], rtol=1e-11, atol=1e-15)
    assert abs(tails.t_two_sided(0.6319, 10) - 0.05) < 1e-4
    assert abs(tails.beta_inc(2.0, 3.0, 0.4) - 0.5248) < 1e-12
    assert tails.t_two_sided(1.0, 5) == 0.0 and tails.t_two_sided(0.5, 2) is None
