"""cloakline — find personal data in Spark string columns, replace it with
stable numbered placeholders, and restore it from the mapping.

Typical use::

    from cloakline import mask, restore
    r = mask(df, text_col="text", key_cols=["doc_id"], scope_cols=["doc_id"])
    r.masked, r.registry, r.mapping, r.stats
    back = restore(r.masked, "text", ["doc_id"], r.mapping, ["doc_id"])
"""

from .plans.jobs import (mask, mask_kind, mask_lines, mask_nodes, mask_runs, mask_table, mask_workbook, restore, restore_kind,
                         restore_runs, restore_table, restore_text_files, restore_workbook)
from .rules import build_rules, load_config, load_rules, rule

__all__ = ["mask", "mask_kind", "mask_lines", "mask_nodes", "mask_runs", "mask_table", "mask_workbook", "restore", "restore_kind",
           "restore_runs", "restore_table", "restore_text_files", "restore_workbook", "build_rules", "load_config", "load_rules", "rule"]
