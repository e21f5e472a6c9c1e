"""Label domains and the predicates defined on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names as they occur in the data and in the prompts.
NORMAL_LABEL = "normal_log"
ATTACK_LABEL = "attack_log"
MISSING_LABEL = "No Label"
LOG_LABELS = [
    "normal_log",
    "dnsteal",
    "attacker_http",
    "service_scan",
    "dns_scan",
    "network_scan",
    "escalate",
    "attacker_vpn",
    "webshell_cmd",
    "dirb",
    "escalated_command",
    "wpscan",
    "traceroute",
    "attacker_change_user",
]
ALERT_LABELS = [
    "Benign",
    "DoS Attack",
    "DDoS Attack",
    "Port Scan",
    "Brute Force Attack",
    "Web Attack",
    "Botnet Attack",
    "Infiltration Attack",
    "Heartbleed",
]
# Report rows that the comparison tables leave out.
SUMMARY_KEYS = ["accuracy", "macro avg", "weighted avg"]
RARE_LABELS = [
    "escalated_command",
    "attacker_vpn",
    "wpscan",
    "attacker_change_user",
    "dirb",
    "traceroute",
    "escalate",
    "webshell_cmd",
]


def is_normal(label: str | Column) -> Column:
    """The row belongs to the normal class."""
    return (F.col(label) if isinstance(label, str) else label) == NORMAL_LABEL


def is_alert(label: str | Column) -> Column:
    """A predicted label raises an alert unless its text contains ``normal``."""
    return ~F.contains(F.col(label) if isinstance(label, str) else label, F.lit("normal"))


def to_binary(label: str | Column) -> Column:
    """Collapse any label to normal or attack."""
    return F.when(is_alert(label), ATTACK_LABEL).when(~is_alert(label), NORMAL_LABEL)


def in_domain(label: str | Column, domain: Sequence[str] = tuple(LOG_LABELS)) -> Column:
    return (F.col(label) if isinstance(label, str) else label).isin(*domain)
