"""Types, enumerations and thresholds of the knowledge store. All of them are fixed values unless passed otherwise."""

from __future__ import annotations

from dataclasses import dataclass

#: The instant that queries take as now.
AS_OF = "2024-02-01 00:00:00"

TYPES = (
    "project_memory", "decision", "user_profile", "environment_fact", "episodic_memory", "feedback",
    "skill_candidate", "timeline_event", "agent_architecture", "raw_event",
)
STATUSES = ("active", "candidate", "stale", "archived", "contradicted", "superseded")
RELATIONS = (
    "supports", "contradicts", "supersedes", "causes", "failure_pattern", "related_to", "part_of", "blocked_by",
)
#: Types that rules treat with care.
PRECIOUS = ("user_profile", "environment_fact", "decision", "project_memory", "skill_candidate")


@dataclass(frozen=True)
class Mode:
    """What a retrieval mode asks of a record: the least score, and the least score of a hit by vector alone."""

    vector_k: int
    entity_k: int
    least: float
    least_vector: float
    threshold: float


MODES = {
    "strict": Mode(30, 30, 0.15, 0.35, 0.35),
    "balanced": Mode(30, 40, 0.18, 0.42, 0.35),
    "recall": Mode(50, 60, 0.14, 0.36, 0.25),
}

#: (skip, update, link) similarities by type, and for other types.
DEDUP = {
    "decision": (0.90, 0.78, 0.65),
    "user_profile": (0.88, 0.75, 0.60),
    "environment_fact": (0.88, 0.75, 0.60),
    "project_memory": (0.88, 0.75, 0.60),
    "episodic_memory": (0.78, 0.65, 0.50),
    "feedback": (0.78, 0.65, 0.50),
    "skill_candidate": (0.85, 0.72, 0.55),
}
DEDUP_OTHER = (0.82, 0.68, 0.55)

#: Weights of the types for a kind of task; 1 where none is given.
TASK_WEIGHTS = {
    "feedback": {"feedback": 1.5, "user_profile": 1.2, "project_memory": 0.9},
    "implementation": {"project_memory": 1.4, "decision": 1.2, "feedback": 1.0},
    "debugging": {"feedback": 1.3, "timeline_event": 1.2, "project_memory": 1.1},
    "general": {},
}
#: Words that tell the kind of a task, in the order in which they are tried.
TASK_WORDS = (
    ("feedback", ("feedback", "preference", "remember", "correction", "偏好", "反馈")),
    ("debugging", ("bug", "debug", "error", "fail", "修复", "错误")),
    ("implementation", ("implement", "build", "feature", "迭代", "实现")),
)

STOP_WORDS = frozenset(
    "a an and are as at be for from how i in is it of on or that the this to with you".split()
)
GREETINGS = frozenset("hi hello hey 你好 嗯 好 ok okay yes no".split())


@dataclass(frozen=True)
class Curation:
    """Ages in days and bounds of the curation rules."""

    stale_days: int = 365
    archive_days: int = 730
    stale_importance: float = 0.45
    stale_feedback: float = -0.5
    precious_importance: float = 0.3
    precious_feedback: float = -2.0
    low_feedback: float = -1.0
    decay_days: int = 30
    decay_step: float = 0.05
    least_confidence: float = 0.15
    episodic_stale_days: int = 14
    episodic_archive_days: int = 30
    episodic_importance: float = 0.65
    episodic_candidate_days: int = 7
    precious_candidate_days: int = 30
    candidate_days: int = 7
    never_accessed_days: int = 14
    contradicted_days: int = 90
    revival_days: int = 7
    revival_effectiveness: float = 0.5
    revival_feedback: float = 0.0
    promote_importance: float = 0.75
    promote_injected: int = 3
    skill_importance: float = 0.65
    skill_feedback: float = 0.0
    unused_days: int = 30
    fragment_days: int = 7


#: Sources whose records are fragments of others.
FRAGMENT_SOURCES = ("atomizer", "governance_split")

#: What governance may do by itself, what it never does, and the confidences below which it rejects.
MUTATING_ACTIONS = (
    "archive_duplicate", "archive_and_merge_duplicate", "mark_contradicted", "archive", "promote", "downgrade",
    "supersede", "split",
)
DELETE_ACTIONS = ("delete", "hard_delete")
REVIEW_CONFIDENCE, AUTO_CONFIDENCE = 0.45, 0.75

LOW_RISK = ("memory_insert", "memory_link_insert", "memory_importance_update", "memory_confidence_update", "no_op")
MEDIUM_RISK = (
    "memory_update", "memory_archive", "memory_status_update", "memory_supersede", "memory_link_delete",
    "governance_decision_update",
)
HIGH_RISK = ("maintenance_cleanup",)
APPROVALS = ("human_accept", "admin_override", "rollback", "maintenance", "auto_policy")

#: The states that may follow each state of an execution.
TRANSITIONS = {
    "planned": ("policy_evaluated",),
    "policy_evaluated": ("queued", "rejected", "applying"),
    "queued": ("applying", "cancelled"),
    "applying": ("applied", "apply_failed"),
    "applied": ("rolling_back",),
    "rolling_back": ("rolled_back", "rollback_failed"),
}
