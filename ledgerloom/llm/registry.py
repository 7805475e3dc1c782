"""Queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from . import (
    best_fit, cross_parse, fair_mix, image_copies, kn_quality, line_rules, phrase_automata, secret_links, simhash_ring,
    toxic_mil,
)


def queries() -> dict:
    return {
        "op1_image_copies": image_copies.query,
        "op2_line_rules": line_rules.query,
        "op3_cross_parse": cross_parse.query,
        "op4_toxic_mil": toxic_mil.query,
        "op5_simhash_ring": simhash_ring.query,
        "op6_kn_quality": kn_quality.query,
        "op7_secret_links": secret_links.query,
        "op8_phrase_automata": phrase_automata.query,
        "op9_best_fit": best_fit.query,
        "op10_fair_mix": fair_mix.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_rules": line_rules.ORACLE_SQL,
        "op7_secret_links": secret_links.ORACLE_SQL,
        "op8_phrase_automata": phrase_automata.ORACLE_SQL,
        "op10_fair_mix": fair_mix.ORACLE_SQL,
    }
