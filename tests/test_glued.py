"""Keys behind word characters: spans, merging with long runs, and that nothing but parts is changed."""

from hypothesis import given
from hypothesis import strategies as st

from spindrift.functions import glued


def test_a_key_that_reaches_out_of_a_run_takes_the_run_along():
    text = "A" * 58 + "AIza" + "b" * 10 + "-" + "c" * 25
    assert glued.glued_spans(text + " x") == [(0, len(text), "google-key")]
    inside = "A" * 20 + "AIza" + "b" * 40
    assert glued.glued_spans(inside) == []  # masked whole by the rule for such runs


def test_finds_that_overlap_are_one_part():
    text = "hf_" + "a" * 30 + "ghp_" + "b" * 20
    assert glued.finds(text)[0][:2] == (0, len(text) - 21) and glued.finds(text)[1][:2] == (len(text) - 24, len(text))  # "ghp" belongs to both
    spans = glued.glued_spans(text)
    assert spans == [(0, len(text), "huggingface-token")]


def test_a_body_that_is_no_key_may_end_in_the_next_prefix():
    assert [k for *_, k in glued.finds("risk-aaaaaaaaaaaaaaaaaaaask-" + "Ab3d" * 6)] == ["api-key"]


@given(st.text(alphabet="aA1_-./ skghp", max_size=60), st.sampled_from(["hf_" + "q" * 30, "glpat-" + "q" * 20, ""]))
def test_parts_are_apart_and_the_rest_stays(before, key):
    text = before + key
    spans = glued.glued_spans(text)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(0 <= a < z <= len(text) for a, z, _ in spans)
    masked, kinds = glued.mask_glued(text)
    assert len(kinds) == len(spans) and len(masked) == len(text) - sum(z - a for a, z, _ in spans) + sum(len(k) + 2 for k in kinds)
    assert not key or key not in masked


def test_rows_without_a_sign_and_nulls_pass(spark):
    df = spark.createDataFrame([(1, None), (2, "plain"), (3, "xglpat-" + "a" * 20)], "id long, t string")
    got = {r.id: (r.out, r.glued_kinds) for r in glued.without_glued(df, "t", "out").collect()}
    assert got == {1: (None, []), 2: ("plain", []), 3: ("x‹gitlab-token›", ["gitlab-token"])}
