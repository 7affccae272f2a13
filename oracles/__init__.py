"""DuckDB SQL twins of the registered queries, for checking results."""

from oracles.base import with_ctes
from oracles.part1 import ENTROPY_CTE
from oracles.part1 import SQL as PART1
from oracles.part2 import EXTRA
from oracles.part2 import SQL as PART2


def all_sql() -> dict[str, str]:
    out = {name: with_ctes(body, {**ENTROPY_CTE, **EXTRA}) for name, body in {**PART1, **PART2}.items()}
    # The same results are asked of the plan for hot keys.
    return out | {f"{name}_cut": out[name] for name in ("m1_behaviour6", "w11_sequence_deviation", "v1_action_validation", "k8_action_choice", "j11_similar_cases")}
