"""Queries opN_<name> of this subpackage, each over its whole table, with production parameters."""

from __future__ import annotations

from ..storage import scan
from .license_scan import license_notices
from .line_dedup import dedup_lines
from .lm_score import lm_scores
from .media import page_media
from .mixing import mix_report
from .near_dedup import near_duplicates
from .packing import pack
from .quality_rules import apply_rules, fit_cutoffs
from .stages import run
from .suffix_dedup import repeated_passages
from .token_ids import rank_rows, token_columns


def op1_lm_score(spark, sf_dir):
    return lm_scores(scan(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return repeated_passages(scan(spark, sf_dir, "documents"))


def op3_media_columns(spark, sf_dir):
    return page_media(scan(spark, sf_dir, "pages"))


def op4_license_scan(spark, sf_dir):
    return license_notices(scan(spark, sf_dir, "documents"))


def op5_token_ids(spark, sf_dir):
    return token_columns(scan(spark, sf_dir, "documents"))[0]


def token_ranks(spark, sf_dir):
    """The second result of op5: which token each of its ids names."""
    return rank_rows(scan(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    return dedup_lines(scan(spark, sf_dir, "documents"))


def op9_near_dedup(spark, sf_dir):
    return near_duplicates(scan(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return pack(scan(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    docs = scan(spark, sf_dir, "documents")
    return apply_rules(docs, fit_cutoffs(docs, scan(spark, sf_dir, "labels")), values=True)


def op10_mixing(spark, sf_dir):
    return mix_report(scan(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_suffix_dedup, op3_media_columns, op4_license_scan, op5_token_ids, token_ranks, op6_line_dedup, op7_packing, op8_quality_rules, op9_near_dedup, op10_mixing, pipeline)}
