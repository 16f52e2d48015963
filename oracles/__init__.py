"""DuckDB SQL for the registered queries, written independently of the Spark operators."""

from oracles.tables import ORACLES  # noqa: F401
import oracles.reports  # noqa: E402,F401
import oracles.models  # noqa: E402,F401
