"""Schemas of the datasets, as DDL; none is inferred in production paths."""

LISTS = ("Test_1", "Test_2", "valid_1", "hallucinated_1", "valid_2", "hallucinated_2", "pip", "pip_valid", "pip_hallucinated")
RESULTS = "Prompts STRING, Answers STRING, " + ", ".join(f"{c} STRING" for c in LISTS)
RECORD = (
    "sample_id STRING, split_type STRING, mode INT, system_prompt STRING, user_prompt STRING, completion STRING, "
    "chosen STRING, rejected STRING, valid_packages ARRAY<STRING>, hallucinated_packages ARRAY<STRING>"
)
MASTER = "Prompts STRING, Questions STRING, Answers STRING"
PACKAGE_RESPONSE = "prefix STRING, input STRING, full_prompt STRING, response STRING"
COMPLETION = "row_index BIGINT, mode INT, system_prompt STRING, user_prompt STRING, completion STRING"
TOKENIZED = "sample_id STRING, split_type STRING, mode INT, input_ids ARRAY<INT>, attention_mask ARRAY<INT>, labels ARRAY<INT>"
TRI_MASK = "id STRING, mode STRING, input_ids ARRAY<INT>, attention_mask ARRAY<INT>, labels ARRAY<INT>, tri_mask ARRAY<INT>, template STRING"
PACKAGE_INFO = "STRUCT<package_name STRING, is_hallucinated BOOLEAN, position_idx INT, is_first BOOLEAN, preceding_separator STRING, char_start INT, char_end INT>"
CONTRASTIVE = (
    "sample_id STRING, base_sample_id STRING, is_shuffled_variation BOOLEAN, variation_idx INT, question STRING, "
    "answer_matching_behavior STRING, answer_not_matching_behavior STRING, completion STRING, "
    f"packages_info ARRAY<{PACKAGE_INFO}>, valid_packages ARRAY<STRING>, hallucinated_packages ARRAY<STRING>, "
    "system_prompt STRING, user_prompt STRING, split_type STRING, mode INT"
)
ACTIVATION = "sample_id STRING, package_name STRING, is_hallucinated BOOLEAN, layer INT, vec ARRAY<FLOAT>"
PAIR_SCORE = "layer INT, multiplier DOUBLE, question STRING, matching_score DOUBLE, not_matching_score DOUBLE"
TOKEN_SCORE = "sample_id STRING, set_name STRING, log_probs ARRAY<DOUBLE>, mask ARRAY<BOOLEAN>, hit ARRAY<BOOLEAN>"
TOKENS = "ARRAY<STRUCT<id INT, s INT, e INT>>"
