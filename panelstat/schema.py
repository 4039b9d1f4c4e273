"""Logical tables, fixed vocabularies and read schemas."""

# These words are part of the data format.
ATTRIBUTES = ["autonomy", "beneficence", "nonmaleficence", "justice"]
TAGS = ["promotes", "violates", "neutral"]
CHOICES = ["choice_1", "choice_2", "REFUSAL"]
STATUSES = ["draft", "needs_review", "approved", "failed", "deprecated"]
CONSENSUS = "human_consensus"
HUMAN_PREFIX = "human/"
NEAR_DUPLICATE = 0.80
REVIEW_COLUMNS = [
    "Case ID", "R1", "R1 Decision?", "R2", "R2 Decision?", "R3", "R3 Decision?", "Status",
    "Vignette", "Choice 1", "Autonomy C1", "Beneficence C1", "Nonmaleficence C1", "Justice C1",
    "Choice 2", "Autonomy C2", "Beneficence C2", "Nonmaleficence C2", "Justice C2",
    "Reviewer Comments",
]

# Nested read schemas. Free-form payloads stay VARIANT, so no schema inference pass is needed.
_OPTION = "STRUCT<choice: STRING, " + ", ".join(f"{a}: STRING" for a in ATTRIBUTES) + ">"
_RUNS = "ARRAY<STRUCT<full_response: VARIANT, parsed_choice: STRING>>"
_RUNS_SLIM = "ARRAY<STRUCT<parsed_choice: STRING>>"


def decision_schema(with_payload: bool = False) -> str:
    """Read schema of a decision document; without payload the reader skips the response bodies."""
    runs = _RUNS if with_payload else _RUNS_SLIM
    return (
        f"case_id STRING, case STRUCT<vignette: STRING, choice_1: {_OPTION}, choice_2: {_OPTION}>, "
        f"system_prompt STRING, user_prompt STRING, "
        f"models MAP<STRING, STRUCT<temperature: DOUBLE, runs: {runs}>>, _corrupt_record STRING"
    )


REGISTRY_ENTRY = (
    "STRUCT<name: STRING, email: STRING, expertise: STRING, first_seen: STRING, last_seen: STRING>"
)
RUBRIC = "MAP<STRING, STRUCT<outcome: BOOLEAN, suggested_changes: STRING>>"
CASE_RECORD = (
    "case_id STRING, created_at STRING, version STRING, model_name STRING, status STRING, "
    "seed STRUCT<mode: STRING, parameters: VARIANT>, "
    "refinement_history ARRAY<STRUCT<iteration: INT, step_description: STRING, timestamp: STRING, "
    f"data: VARIANT, clinical_evaluation: {RUBRIC}, ethical_evaluation: {RUBRIC}, "
    f"stylistic_evaluation: {RUBRIC}, equipoise_evaluation: {RUBRIC}, "
    f"value_validations: MAP<STRING, {RUBRIC}>, feedback: MAP<STRING, STRING>, "
    "human_evaluation: VARIANT>>, _corrupt_record STRING"
)
EVALUATION = (
    "case_id STRING, case_content_hash STRING, evaluator STRING, evaluated_at STRING, "
    "decision STRING, problem_axes ARRAY<STRING>, comments STRING, evaluation_version STRING"
)
SESSION = (
    "username STRING, session_id STRING, started_at STRING, last_updated STRING, "
    "reviewed_case_ids ARRAY<STRING>"
)
SEED = "case STRING, value_1 STRING, value_2 STRING, scenario_type STRING"
