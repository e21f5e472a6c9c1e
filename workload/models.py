"""Deterministic stand-ins for the scoring model. Their rules are repeated as CASE in the oracles."""

from __future__ import annotations

import json
import re

from vigilog.operators.scoring import keyword_model

TEXT_RULES = [("mente", "dns_scan"), ("eaux", "dirb"), ("ation", "low"), ("ch", "toxic")]
FAILS_ON = "ndtionth"
CONTEXT_RULES = [('"label":"dirb"', "dirb"), ('"label":"dns_scan"', "dns_scan"), ('"label":"toxic"', "toxic"), ('"label":"low"', "low")]


def text_model():
    """Gives no reply to some texts."""
    known = keyword_model(TEXT_RULES, "normal_log")()

    def call(system: str, user_prompt: str) -> tuple[int, str]:
        if FAILS_ON in user_prompt:
            raise TimeoutError("no reply")
        return known(system, user_prompt)

    return call


def context_model():
    return keyword_model(CONTEXT_RULES, "normal_log")()


def alert_model():
    """Answers by the alert's type and its ``k``; one type walks through the failures."""

    def answer(label: str, confidence: float) -> tuple[int, str]:
        content = json.dumps({"final_attack_label": label, "explanation": "by type", "confidence": confidence})
        return 200, json.dumps({"choices": [{"message": {"content": content}}]})

    def call(_system: str, user_prompt: str) -> tuple[int, str]:
        kind = re.search(r'"type": "(\w+)"', user_prompt).group(1)
        k = int(re.search(r'"k": (\d+)', user_prompt).group(1))
        if kind == "error":
            return answer("DoS Attack", 0.9)
        if kind == "click":
            return answer("Benign", 0.75)
        if kind == "view":
            return answer("Nothing", 0.5)
        if kind == "purchase":
            return answer("Botnet Attack", 1.5)
        if k < 25:
            return 500, "overloaded"
        if k < 50:
            return 200, json.dumps({"choices": [{"message": {"content": "nope"}}]})
        if k < 75:
            return 200, json.dumps({"choices": []})
        raise TimeoutError("no reply")

    return call
