"""newsloom: a PySpark-native document-intelligence engine.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); rule tables, gazetteers and weights are arguments, and every "now" is
an explicit ``as_of``.
"""

from newsloom.session import build_session, checkpoint_root, cut_lineage

__all__ = ["build_session", "checkpoint_root", "cut_lineage"]
