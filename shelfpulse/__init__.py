"""shelfpulse: period-over-period commerce insights as lazy Spark DataFrame operators.

Every public operator takes DataFrames plus plain parameters and returns a lazy
DataFrame.  Nothing is collected to the driver inside an operator; the only
driver-side values are the final one-row-per-account report and scalar
parameters (dates, thresholds).
"""

from shelfpulse.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
