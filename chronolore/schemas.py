"""Table schemas and fixed value sets. Text columns of the graph are never null."""

from __future__ import annotations

# The ontology.
SYSTEMS = ["SLACK", "NOTION", "ZOOM", "FILESYSTEM"]
EPISODE_KINDS = ["SLACK_THREAD", "SLACK_CHANNEL_WINDOW", "MEETING_TRANSCRIPT", "NOTION_PAGE", "DOCUMENT"]
VISIBILITIES = ["PUBLIC", "RESTRICTED", "PRIVATE"]
REQUIRED_FIELDS = {
    "DECISION": ["STATEMENT", "EVIDENCE"],
    "ACTION_ITEM": ["STATEMENT", "OWNER", "EVIDENCE"],
    "COMMITMENT": ["STATEMENT", "OWNER", "EVIDENCE"],
    "RISK": ["STATEMENT", "EVIDENCE"],
    "OPEN_QUESTION": ["STATEMENT", "EVIDENCE"],
}
FACT_FIELDS = ["STATEMENT", "OWNER", "PARTICIPANTS", "OCCURRED_AT", "DUE_DATE", "STATUS", "TOPICS", "EVIDENCE"]
STATUSES = ["PROPOSED", "AGREED", "IN_PROGRESS", "DONE", "BLOCKED", "SUPERSEDED", "ABANDONED"]
METHOD_CONFIDENCE = {"EMAIL": 1.0, "EXACT_NAME": 0.95, "HANDLE": 0.98, "UNIQUE_IN_EPISODE": 0.85, "LLM_ADJUDICATED": 0.7, "UNRESOLVED": 0.0}
DETERMINISTIC_METHODS = ["EMAIL", "EXACT_NAME", "HANDLE"]
VERDICTS = ["SUPERSEDES", "DUPLICATE", "UNRELATED"]
PATH_EDGES = ["SUPERSEDES", "DUPLICATE_OF", "OWNED_BY", "INVOLVES", "ABOUT", "DERIVED_FROM"]
ONTOLOGY_VERSION = "1.0.0"
PROMPT_VERSION = "extract-v2"
PROMPT_SIGNATURE = f"{PROMPT_VERSION}/ontology-{ONTOLOGY_VERSION}"

EVIDENCE = "struct<episode_id: string, ordinal: int, span: string>"
ISSUE = "struct<severity: string, field: string, message: string>"

EPISODES = "episode_id string, system string, external_id string, kind string, title string, occurred_at timestamp, ingested_at timestamp, permalink string, scope_id string, visibility string, acl_grants array<string>, content_hash string"
UTTERANCES = "episode_id string, ordinal int, system string, raw_id string, speaker string, at timestamp, text string, permalink string"
EXTRACTED_FACTS = f"episode_id string, type string, statement string, owner_mention string, participant_mentions array<string>, occurred_at timestamp, due_date date, status string, topics array<string>, evidence array<{EVIDENCE}>, confidence double"
FACTS = f"fact_id string, {EXTRACTED_FACTS}, valid_from timestamp, valid_to timestamp, superseded_by string, acl_grants array<string>, visibility string, ontology_version string, prompt_version string, embedding array<float>"
PEOPLE = "person_id string, name string, email string, title string, aliases array<string>"
ALIASES = "system string, value string, person_id string"

USERS = "id string, name string, real_name string, profile struct<display_name: string, email: string, title: string>"
THREAD = "channel struct<id: string, name: string, visibility: string>, thread_ts string, messages array<struct<ts: string, user: string, text: string, permalink: string>>"
MEETING = "uuid string, topic string, start_time string, end_time string, scope struct<id: string, visibility: string>, participants array<struct<name: string, email: string>>"
GOLD_FACTS = "facts array<struct<id: string, type: string, statement: string, owner: string, occurred_at: string, due_date: string, status: string, supersedes: string, superseded_by: string, sources: array<string>, source_keys: array<string>, acl: string, note: string>>"
GOLD_QUESTIONS = "questions array<struct<id: string, question: string, principal: array<string>, expected: string, expected_facts: array<string>, must_not_say: array<string>, must_not_lead_with: array<string>, trap: string>>"
GOLD_ENTITIES = "entities array<struct<canonical: string, email: string, aliases: array<struct<system: string, value: string>>>>, non_matches array<struct<pair: array<string>, why: string>>"
RUN_FACT = "struct<type: string, statement: string, ownerMention: string, participantMentions: array<string>, occurredAt: string, dueDate: string, status: string, topics: array<string>, evidence: array<struct<episodeId: string, utteranceOrdinal: int, verbatimSpan: string>>, confidence: double>"
RUN = f"episodeId string, accepted array<{RUN_FACT}>, rejected array<struct<fact: {RUN_FACT}, issues: array<{ISSUE}>>>, warnings array<{ISSUE}>, promptSignature string, elapsed string, inputTokens int, outputTokens int"
PAYLOAD = "facts array<struct<type: string, statement: string, owner: string, participants: array<string>, occurredAt: string, dueDate: string, status: string, topics: array<string>, evidence: array<struct<utterance: int, quote: string>>, confidence: double>>"


def payload_json_schema() -> dict:
    """JSON Schema that a model's answer is held to, from the ontology."""
    text, texts = {"type": ["string", "null"]}, {"type": "array", "items": {"type": "string"}}
    quote = {"type": "object", "properties": {"utterance": {"type": "integer", "minimum": 0}, "quote": {"type": "string"}}, "required": ["utterance", "quote"], "additionalProperties": False}
    fact = {
        "type": {"type": "string", "enum": list(REQUIRED_FIELDS)},
        "statement": {"type": "string"},
        "owner": text,
        "participants": texts,
        "occurredAt": text,
        "dueDate": text,
        "status": {"type": "string", "enum": [s for s in STATUSES if s != "SUPERSEDED"]},
        "topics": texts,
        "evidence": {"type": "array", "items": quote},
        "confidence": {"type": "number", "minimum": 0, "maximum": 1},
    }
    item = {"type": "object", "properties": fact, "required": list(fact), "additionalProperties": False}
    return {"type": "object", "properties": {"facts": {"type": "array", "items": item}}, "required": ["facts"], "additionalProperties": False}
