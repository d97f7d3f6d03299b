"""Fixed schemas of the tables that jobs exchange."""

METRICS_LONG = (
    "method string, seed int, budget_requested long, budget_achieved long, l2_lambda double, holdout_type string, fold int, "
    "split string, scope string, scope_value string, metric string, value double")
TARGET_DIAGNOSTICS = (
    "method string, l2_lambda double, seed int, budget_requested long, split string, target_name string, family string, geography_level string, "
    "target_value double, achieved_value double, scale double, loss_weight double, absolute_relative_error double, is_degenerate boolean")
RUNS = (
    "method string, seed int, budget_requested long, budget_achieved long, l2_lambda double, holdout_type string, fold int, artifact_path string, "
    "weight_entity string, candidate_records long, n_selected long, runtime_s double, l0_lambda double, final_loss double, target_loss_cap double")
TARGETS = (
    "target_pos long, target_name string, entity string, measure string, value double, family string, geography_level string, basis string, "
    "filter map<string,string>, metadata map<string,string>, validation_only boolean")
MATRIX = "target_name string, record_id long, value double"
WEIGHTS = "method string, seed int, budget_requested long, l2_lambda double, holdout_type string, fold int, record_id long, weight double"
LOSS_HISTORY = "method string, seed int, budget_requested long, l2_lambda double, epoch int, loss double, n_open double"
CROSSWALK = "source_geography_id string, target_geography_id string, weight double"

RUN_KEYS = ("method", "seed", "budget_requested", "l2_lambda")


def names(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out
