"""Plan helpers: materialisation points and plan inspection."""

from supplyrisk.plans.materialize import intermediates, materialize, scratch
from supplyrisk.plans.inspect import plan_text, exchanges, has_python_udf

__all__ = ["intermediates", "materialize", "scratch", "plan_text", "exchanges", "has_python_udf"]
