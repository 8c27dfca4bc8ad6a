"""Settings as nested dictionaries with defaults: later sources win, dictionaries merge, lists are replaced whole."""

from __future__ import annotations

import copy
from typing import Any

# Defaults of every setting.
DEFAULTS: dict[str, Any] = {
    "low_pass": {
        "hard_skip_labels": ["invalid", "wontfix", "duplicate", "stale"],
        "soft_suppress_labels": ["question", "discussion"],
        "skip_closed": True,
        "skip_drafts": True,
        "ignore_recent_pr_hours": None,
        "boost_labels": {"security": 1.5, "regression": 1.5},
        "stale_days": 90,
        "stale_action": "skip",
        "suppress_docs_only_if_no_ci": True,
        "docs_suffixes": [".md", ".rst", ".txt"],
        "docs_prefixes": ["docs/", ".github/"],
        "suppress_bot_authors": False,
        "bot_patterns": ["[bot]", "bot"],
        "issue_template_match_threshold": 0.7,
        "issue_template_max_content_tokens": 12,
        "issue_template_action": "suppress",
        "issue_one_liner_max_tokens": 14,
        "issue_one_liner_action": "suppress",
        "pr_min_body_tokens": 0,
        "pr_min_body_action": "suppress",
        "pr_large_max_files": 40,
        "pr_large_max_churn": 5000,
        "pr_large_action": "skip",
        "pr_unenriched_max_age_hours": None,
        "pr_unenriched_action": "suppress",
    },
    "similarity": {
        "use_advanced": True,
        "advanced_for_issues": False,
        "min_score": 0.72,
        "strong_score": 0.82,
        "top_k": 64,
        "cluster_tail_prune_score": 0.16,
        "split_size": 10,
        "split_semantic_text": 0.65,
        "split_title": 0.20,
        "split_hard_link": 0.50,
        "split_lineage_hunk": 0.80,
        "split_lineage_semantic": 0.80,
        "max_file_bucket": 300,
        "max_module_bucket": 800,
        "min_votes": 1,
        "min_votes_large": 2,
        "large_run_threshold": 2000,
        "weights": {
            "lineage": 0.35, "structure": 0.30, "semantic": 0.12, "minhash": 0.10, "simhash": 0.06, "winnow": 0.07,
            "size_penalty": 0.10,
        },
        "semantic_text_share": 0.65,
        "semantic_diff_share": 0.35,
        "lineage_strong": 0.50,
        "lineage_min_shared": 2,
        "hard_link_strong": 0.50,
        "hard_link_weak": 0.20,
        "hard_link_semantic_strong": 0.50,
        "hard_link_semantic_issue_pr": 0.35,
        "hard_link_semantic_weak": 0.45,
        "pr_semantic": {"structure": 0.20, "semantic": 0.70, "simhash": 0.70, "title": 0.08},
        "weak": {"structure": 0.25, "semantic": 0.30, "minhash": 0.40, "simhash": 0.65, "winnow": 0.20},
        "strong_minhash": 0.85,
        "strong_winnow": 0.55,
        "unstructured": {"semantic": 0.96, "minhash": 0.90, "winnow": 0.85},
        "unstructured_pr": {"title": 0.95, "semantic_text": 0.58, "simhash": 0.64},
        "broad_pr": {"min_files": 10, "pair_min_files": 5, "title": 0.20, "semantic_text": 0.55},
        "minhash_permutations": 64,
        "minhash_bands": 8,
        "shingle_k": 3,
        "simhash_chunk": 16,
        "winnow_k": 5,
        "winnow_window": 4,
    },
    "canonical": {
        "weights": {"coverage": 5, "centrality": 4, "ci": 3, "reviewer": 2, "approvals": 1.5, "priority": 1, "size_penalty": 1},
        "duplicate_threshold": 0.22,
        "duplicate_file": 0.80,
        "duplicate_hunk": 0.80,
        "duplicate_title": 0.20,
        "duplicate_semantic_text": 0.85,
        "duplicate_file_title": 0.80,
        "duplicate_hard_link": 0.50,
        "duplicate_hard_link_file": 0.90,
        "duplicate_hard_link_hunk": 0.20,
        "duplicate_hard_link_title": 0.80,
        "veto_title": 0.05,
        "veto_semantic_text": 0.72,
        "veto_hard_link": 1.0,
        "tie_margin": 0.10,
        "tie_similarity": 0.25,
        "tie_hard_link": 0.50,
        "tie_hunk": 0.20,
        "tie_file": 0.80,
        "tie_semantic_text": 0.75,
    },
    "labels": {
        "canonical": "triage/canonical",
        "duplicate": "triage/duplicate",
        "related": "triage/related",
        "linked_pair": "triage/linked-pair",
        "quarantine": "triage/quarantine",
        "noise_suppressed": "triage/noise-suppressed",
        "close_candidate": "triage/close-candidate",
        "ready_human": "triage/ready-human",
    },
    "action": {
        "safe_mode": True,
        "add_comments": True,
        "queue_on_suppress": True,
        "close_comment": "Auto-closing due to low-signal triage policy. Reopen with more details if needed.",
    },
    "ingest": {"page_size": 100, "resume": True, "checkpoint_every_pages": 5, "enrich": False},
    "embedding": {"provider": "local-hash", "model": "hash-embed-v1", "dims": 256},
    "storage": {"persist_runs": False},
}

#: Dictionaries whose keys are the user's own.
OPEN = {("low_pass", "boost_labels")}


def merged(*sources: dict[str, Any]) -> dict[str, Any]:
    """The defaults under each source in turn. Unknown settings are errors."""
    out = copy.deepcopy(DEFAULTS)

    def lay(onto: dict, source: dict, path: tuple[str, ...]) -> None:
        for key, value in source.items():
            if key not in onto and path not in OPEN:
                raise KeyError(f"unknown setting {'.'.join((*path, key))}")
            if isinstance(onto.get(key), dict) and isinstance(value, dict):
                lay(onto[key], value, (*path, key))
            else:
                onto[key] = copy.deepcopy(value)

    for source in sources:
        lay(out, source, ())
    return out
