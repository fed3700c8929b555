"""Finding, masking and reporting secrets in text, as Spark DataFrame operations."""

from .operators.backup import backup, forget, restore
from .operators.backup_log import BackupLog
from .operators.catalogue import BUILTIN_RULES, CATEGORIES, Rule, custom_rule
from .operators.detect import detect, findings
from .operators.mask import mask, protect, redact, vault_of
from .operators.normalise import normalise, redact_findings
from .operators.rule_index import RuleIndex, rule_index
from .operators.score import classify
from .operators.unmask import unmask_inline, unmask_numbered, unmask_vault
from .plans.evaluate import confusion, evaluate, missed
from .plans.report import (
    by_category,
    max_risk,
    merge_states,
    per_file,
    repeated_secrets,
    report_state,
    riskiest,
    state_summary,
    summary,
)
from .sources.chunks import chunk_findings, load_chunks, protect_chunks, split_long
from .sources.corpus import list_corpus, load_checked, load_corpus, read_outcomes, spread, unread_files
from .sources.reports import html_tables, write_redacted, write_report
from .sources.rule_config import load_rules, parse_rules, usable_rules
from .streaming.live import finding_counts, mask_stream, new_secrets, protect_stream, unmask_stream
from .streaming.vault import compact_vault, read_vault

__all__ = [
    "BUILTIN_RULES",
    "BackupLog",
    "CATEGORIES",
    "Rule",
    "RuleIndex",
    "backup",
    "by_category",
    "chunk_findings",
    "classify",
    "compact_vault",
    "confusion",
    "custom_rule",
    "detect",
    "evaluate",
    "finding_counts",
    "findings",
    "forget",
    "html_tables",
    "list_corpus",
    "load_checked",
    "load_chunks",
    "load_corpus",
    "load_rules",
    "mask",
    "mask_stream",
    "max_risk",
    "merge_states",
    "missed",
    "new_secrets",
    "normalise",
    "parse_rules",
    "per_file",
    "protect",
    "protect_chunks",
    "protect_stream",
    "read_outcomes",
    "read_vault",
    "redact",
    "redact_findings",
    "repeated_secrets",
    "report_state",
    "restore",
    "riskiest",
    "rule_index",
    "split_long",
    "spread",
    "state_summary",
    "summary",
    "unmask_inline",
    "unmask_numbered",
    "unmask_stream",
    "unmask_vault",
    "unread_files",
    "usable_rules",
    "vault_of",
    "write_redacted",
    "write_report",
]
