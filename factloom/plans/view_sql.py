"""The published relations as SQL for DuckDB: what the DataFrames are held against.

Names and columns of the relations are the published contract: fixed values.
"""

from __future__ import annotations

from factloom.sources.spine import duckdb_tables

NOW = "TIMESTAMP '2024-01-15 00:00:00'"
HELD = f"(valid_from IS NULL OR valid_from <= {NOW}) AND (valid_until IS NULL OR valid_until > {NOW})"

VIEWS: dict[str, str] = {
    "v_documents_live": """
        SELECT d.deployment_id, d.doc_id, d.source_kind, d.source_ref, d.source_uri, d.title, d.versioning_mode, d.origin, d.first_seen_at, d.last_observed_at, v.version_id AS current_version_id, v.version_no AS current_version_no,
          v.status AS current_version_status, r.representation_id AS current_representation_id, r.representation_id IS NOT NULL AND v.status = 'ready' AS has_current_ready_content, v.source_modified_at, v.published_at, v.language
        FROM documents d LEFT JOIN document_versions v ON v.version_id = d.current_version_id AND v.doc_id = d.doc_id AND v.deleted_at IS NULL
        LEFT JOIN document_representations r ON r.version_id = v.version_id AND r.representation_id = v.current_representation_id AND r.status = 'ready'
        WHERE d.deleted_at IS NULL""",
    "v_document_versions_visible": """
        SELECT v.deployment_id, v.version_id, v.doc_id, v.version_no, v.content_hash, v.source_version_ref, v.status, v.current_representation_id, v.ingested_at, v.source_modified_at, v.published_at, v.language, v.superseded_at,
          v.version_id IS NOT DISTINCT FROM d.current_version_id AS is_current_version
        FROM document_versions v JOIN v_documents_live d USING (doc_id) WHERE v.deleted_at IS NULL""",
    "v_sections_live": """
        SELECT s.* FROM document_sections s JOIN v_documents_live d ON d.has_current_ready_content AND d.doc_id = s.doc_id AND d.current_version_id = s.version_id AND d.current_representation_id = s.representation_id
        JOIN document_representations r ON r.representation_id = s.representation_id AND r.current_structure_generation_id = s.structure_generation_id""",
    "v_chunks_live": """
        SELECT c.* REPLACE (s.section_id AS section_id) FROM chunks c JOIN v_documents_live d ON d.has_current_ready_content AND d.doc_id = c.doc_id AND d.current_version_id = c.version_id AND d.current_representation_id = c.representation_id
        LEFT JOIN v_sections_live s ON s.section_id = c.section_id AND s.version_id = c.version_id""",
    "v_visible_chunks": """
        SELECT c.chunk_id, c.doc_id, c.version_id, c.representation_id FROM chunks c JOIN v_document_versions_visible v USING (version_id, doc_id) JOIN document_representations r ON r.representation_id = c.representation_id AND r.version_id = c.version_id AND r.status = 'ready'""",
    "v_claims_visible_history": """
        SELECT c.deployment_id, c.claim_id, c.doc_id, k.version_id, k.representation_id, c.chunk_id, c.claim_text, c.source_span, c.char_start, c.char_end, c.added_context, c.temporal_class, c.is_attributed, c.audit_status, c.kept_flagged, c.extractor_version, c.asserted_at,
          c.claim_valid_from, c.claim_valid_until, c.claim_valid_precision, c.claim_valid_kind, c.ingested_at, d.source_kind, d.source_kind || ':' || coalesce(d.source_ref, d.doc_id) AS source_handle, c.is_current_testimony
        FROM claims c JOIN v_visible_chunks k ON k.chunk_id = c.chunk_id AND k.doc_id = c.doc_id JOIN v_documents_live d ON d.doc_id = c.doc_id""",
    "v_claims_live": "SELECT * EXCLUDE (is_current_testimony) FROM v_claims_visible_history WHERE is_current_testimony",
    "v_claim_occurrences_live": """
        SELECT cc.deployment_id, cc.claim_id, cc.chunk_id, cc.derivation_kind, k.doc_id, k.version_id, k.representation_id, k.section_id, cc.evidence_mode, cc.created_at AS attached_at
        FROM chunk_claims cc JOIN v_chunks_live k USING (chunk_id) JOIN v_claims_visible_history h ON h.claim_id = cc.claim_id AND h.doc_id = k.doc_id
        QUALIFY row_number() OVER (PARTITION BY cc.claim_id, cc.chunk_id, cc.derivation_kind ORDER BY cc.created_at, cc.evidence_mode) = 1""",
    "v_testimony_currency_events_visible": """
        SELECT e.* REPLACE (v.version_id AS from_version_id) FROM testimony_currency_events e JOIN v_claims_visible_history h USING (claim_id, doc_id) LEFT JOIN v_document_versions_visible v ON v.version_id = e.from_version_id AND v.doc_id = e.doc_id""",
    "v_survivors": """
        WITH RECURSIVE walk AS (
          SELECT entity_id, entity_id AS at FROM entities
          UNION SELECT w.entity_id, e.merged_into FROM walk w JOIN entities e ON e.entity_id = w.at WHERE e.merged_into IS NOT NULL)
        SELECT 'main' AS deployment_id, w.entity_id, w.at AS survivor_entity_id FROM walk w JOIN entities e ON e.entity_id = w.at WHERE e.merged_into IS NULL""",
    "v_decisions": "SELECT * FROM resolution_decisions WHERE superseded_by IS NULL QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY decided_at DESC, decision_id DESC) = 1",
    "v_mention_current_content": """
        SELECT m.deployment_id, m.mention_id, k.doc_id, k.version_id, k.representation_id, k.chunk_id, k.section_id, h.claim_id, m.surface_form, m.normalized_lemma, m.canonical_name_form, m.emitted_type, m.type_confidence, m.language, m.char_start, m.char_end, m.created_at,
          s.survivor_entity_id, r.method AS resolution_method, r.confidence AS resolution_confidence, r.is_new_entity AS resolution_is_new_entity, r.decided_at AS resolved_at
        FROM mentions m JOIN v_chunks_live k ON k.chunk_id = m.chunk_id AND k.doc_id = m.doc_id LEFT JOIN v_claims_visible_history h ON h.claim_id = m.claim_id AND h.doc_id = k.doc_id
        LEFT JOIN v_decisions r ON r.mention_id = m.mention_id LEFT JOIN v_survivors s ON s.entity_id = r.entity_id""",
    "v_entity_document_mentions": """
        SELECT m.deployment_id, m.survivor_entity_id AS entity_id, m.doc_id, count(*) AS mention_count, min(m.created_at) AS first_mentioned_at, max(m.created_at) AS last_mentioned_at
        FROM v_mention_current_content m JOIN entities e ON e.entity_id = m.survivor_entity_id AND e.status = 'active' GROUP BY ALL""",
    "v_entities_current": """
        WITH backed AS (
          SELECT r.entity_id FROM mentions m JOIN v_visible_chunks k ON k.chunk_id = m.chunk_id AND k.doc_id = m.doc_id JOIN v_decisions r USING (mention_id)
          UNION SELECT document_entity_id FROM documents WHERE deleted_at IS NULL),
        counts AS (SELECT entity_id, CAST(sum(mention_count) AS BIGINT) AS m, count(*) AS d FROM v_entity_document_mentions GROUP BY 1)
        SELECT e.deployment_id, e.entity_id, e.type AS entity_type, e.canonical_name, e.normalized_name, e.type_confidence, e.profile_summary, coalesce(c.m, 0) AS live_mention_count, coalesce(c.d, 0) AS live_document_count, CAST(e.graph_degree AS BIGINT) AS graph_degree, e.created_at, e.updated_at
        FROM entities e LEFT JOIN counts c USING (entity_id) WHERE e.status = 'active' AND e.entity_id IN (SELECT s.survivor_entity_id FROM v_survivors s JOIN backed b USING (entity_id))""",
    "v_resolved": "SELECT s.entity_id, s.survivor_entity_id AS survivor FROM v_survivors s JOIN v_entities_current c ON c.entity_id = s.survivor_entity_id",
    "v_entity_aliases_current": """
        SELECT a.deployment_id, a.alias_id, a.entity_id AS source_entity_id, r.survivor AS entity_id, a.alias_text, a.normalized_lemma, a.provenance, a.confidence, a.first_seen, a.last_seen FROM aliases a JOIN v_resolved r USING (entity_id)""",
    "v_mentions_live": """
        SELECT m.* EXCLUDE (survivor_entity_id) REPLACE (CASE WHEN c.entity_id IS NOT NULL THEN m.resolution_method END AS resolution_method, CASE WHEN c.entity_id IS NOT NULL THEN m.resolution_confidence END AS resolution_confidence,
          CASE WHEN c.entity_id IS NOT NULL THEN m.resolution_is_new_entity END AS resolution_is_new_entity, CASE WHEN c.entity_id IS NOT NULL THEN m.resolved_at END AS resolved_at), c.entity_id AS resolved_entity_id
        FROM v_mention_current_content m LEFT JOIN v_entities_current c ON c.entity_id = m.survivor_entity_id""",
    "v_identity_events_visible": """
        SELECT d.deployment_id, 'resolution_decision' AS object_kind, d.decision_id AS event_id, r.survivor AS entity_id, CAST(NULL AS VARCHAR) AS related_entity_id, d.mention_id, CASE WHEN d.is_new_entity THEN 'new_entity' ELSE 'linked' END AS outcome,
          d.method, d.confidence, d.decided_by, d.decided_at, d.superseded_by IS NOT NULL AS is_superseded
        FROM resolution_decisions d JOIN v_resolved r USING (entity_id) JOIN v_mentions_live m ON m.mention_id = d.mention_id
        UNION ALL SELECT e.deployment_id, 'merge_event', e.merge_id, r.survivor, e.absorbed_id, NULL, CASE WHEN e.reversed_by IS NULL THEN 'merge' ELSE 'unmerge' END, 'merge_event', NULL, e.decided_by, e.decided_at, e.reversed_by IS NOT NULL
        FROM merge_events e JOIN v_resolved r ON r.entity_id = e.survivor_id""",
    "v_evidence": """
        SELECT deployment_id, 'relation' AS fact_kind, relation_id AS fact_id, claim_id, doc_id, stance, created_at AS linked_at FROM relation_evidence
        UNION ALL SELECT deployment_id, 'observation', observation_id, claim_id, doc_id, stance, created_at FROM observation_evidence""",
    "v_fact_visible": """
        WITH borne AS (SELECT DISTINCT e.fact_kind, e.fact_id FROM v_evidence e JOIN v_claims_visible_history h USING (claim_id, doc_id))
        SELECT r.deployment_id, 'relation' AS fact_kind, r.relation_id AS fact_id, s.survivor AS subject_entity_id, r.predicate, o.survivor AS object_entity_id, CAST(NULL AS VARCHAR) AS statement, r.fact_label, r.valid_from, r.valid_until, r.ingested_at, r.invalidated_at, r.contradiction_group, r.confidence
        FROM relations r JOIN v_resolved s ON s.entity_id = r.subject_entity_id JOIN v_resolved o ON o.entity_id = r.object_entity_id JOIN borne b ON b.fact_kind = 'relation' AND b.fact_id = r.relation_id
        UNION ALL SELECT o.deployment_id, 'observation', o.observation_id, s.survivor, NULL, NULL, o.statement, o.obs_label, o.valid_from, o.valid_until, o.ingested_at, o.invalidated_at, o.contradiction_group, o.confidence
        FROM observations o JOIN v_resolved s ON s.entity_id = o.subject_entity_id JOIN borne b ON b.fact_kind = 'observation' AND b.fact_id = o.observation_id""",
    "v_fact_claims": """
        SELECT e.*, c.source_kind, c.source_handle, c.asserted_at, c.claim_valid_from, c.claim_valid_until, c.claim_valid_precision, c.claim_valid_kind FROM v_evidence e JOIN v_claims_live c USING (claim_id, doc_id)""",
    "v_lineages": """
        SELECT deployment_id, fact_kind, fact_id, doc_id, stance, source_kind, source_handle, count(*) AS claim_count, first(claim_id ORDER BY asserted_at DESC NULLS LAST, claim_id) AS representative_claim_id, min(asserted_at) AS asserted_from, max(asserted_at) AS asserted_to
        FROM v_fact_claims GROUP BY ALL""",
    "v_fact_claim_evidence_live": "SELECT c.* FROM v_fact_claims c SEMI JOIN v_fact_visible f USING (fact_kind, fact_id)",
    "v_evidence_lineage": "SELECT l.* FROM v_lineages l SEMI JOIN v_fact_visible f USING (fact_kind, fact_id)",
    "v_facts_visible_history": """
        WITH counts AS (SELECT fact_kind, fact_id, count(*) FILTER (WHERE stance = 'supports') AS s, count(*) FILTER (WHERE stance = 'contradicts') AS c FROM v_lineages GROUP BY 1, 2),
        waiting AS (SELECT DISTINCT candidate ->> '$.fact_kind' AS fact_kind, candidate ->> '$.fact_id' AS fact_id FROM review_queue WHERE item_kind = 'support_withdrawn' AND status IN ('pending', 'deferred'))
        SELECT f.*, coalesce(n.s, 0) AS evidence_count_current, coalesce(n.c, 0) AS contradict_count_current, CASE WHEN w.fact_id IS NULL THEN 'current' ELSE 'withdrawn' END AS support_state_current
        FROM v_fact_visible f LEFT JOIN counts n USING (fact_kind, fact_id) LEFT JOIN waiting w USING (fact_kind, fact_id)""",
    "v_facts_current": f"""
        SELECT * EXCLUDE (invalidated_at, evidence_count_current, contradict_count_current, support_state_current), evidence_count_current AS evidence_count, contradict_count_current AS contradict_count, support_state_current AS support_state, {NOW} AS evaluated_at
        FROM v_facts_visible_history WHERE ingested_at <= {NOW} AND invalidated_at IS NULL AND {HELD}""",
    "v_contradiction_members_current": """
        SELECT deployment_id, contradiction_group, fact_kind, fact_id, fact_label, valid_from, valid_until, ingested_at, evidence_count, contradict_count, support_state, evaluated_at FROM v_facts_current WHERE contradiction_group IS NOT NULL""",
    "v_graph_edges_current": "SELECT * EXCLUDE (fact_kind, fact_id, statement), fact_id AS relation_id FROM v_facts_current WHERE fact_kind = 'relation'",
    "v_graph_edges_visible_history": "SELECT * EXCLUDE (fact_kind, fact_id, statement), fact_id AS relation_id FROM v_facts_visible_history WHERE fact_kind = 'relation'",
    "v_document_crossrefs_live": """
        SELECT r.* EXCLUDE (resolved) FROM document_crossrefs r JOIN v_documents_live a ON a.doc_id = r.from_doc_id JOIN v_documents_live b ON b.doc_id = r.to_doc_id WHERE r.resolved""",
    "v_page_citations": """
        SELECT e.deployment_id, e.artifact_id, e.role, CASE WHEN e.claim_lineage_id IS NULL THEN 'document' ELSE 'claim' END AS target_kind, d.doc_id AS target_id, e.claim_chunk_content_hash
        FROM knowledge_artifact_evidence e JOIN v_documents_live d ON d.doc_id = coalesce(e.claim_lineage_id, e.doc_id) WHERE e.claim_lineage_id IS NOT NULL OR e.relation_id IS NULL
        UNION ALL SELECT e.deployment_id, e.artifact_id, e.role, 'relation', e.relation_id, e.claim_chunk_content_hash
        FROM knowledge_artifact_evidence e JOIN v_fact_visible f ON f.fact_kind = 'relation' AND f.fact_id = e.relation_id WHERE e.claim_lineage_id IS NULL""",
    "v_pages_live": """
        WITH shown AS (SELECT a.* FROM knowledge_artifacts a SEMI JOIN v_page_citations c USING (artifact_id) WHERE a.status <> 'tombstoned'),
        waiting AS (SELECT * FROM knowledge_refresh_queue WHERE processed_at IS NULL)
        SELECT a.deployment_id, a.artifact_id, a.layer, a.page_kind, a.git_path, a.kind, p.artifact_id AS parent_artifact_id, a.page_summary, a.status, a.last_compiled_at,
          a.page_kind = 'compiled' AND (a.status = 'stale' OR a.artifact_id IN (SELECT artifact_id FROM waiting)) AS is_stale,
          (SELECT count(*) FROM waiting q WHERE q.artifact_id = a.artifact_id AND q.trigger = 'authored_review' AND a.page_kind = 'authored') AS open_review_flags,
          coalesce((SELECT bool_or(coalesce(CAST(q.payload ->> '$.redaction_required' AS BOOLEAN), false)) FROM waiting q WHERE q.artifact_id = a.artifact_id AND q.trigger = 'authored_review' AND a.page_kind = 'authored'), false) AS redaction_required
        FROM shown a LEFT JOIN shown p ON p.artifact_id = a.parent_artifact_id""",
    "v_page_evidence_visible": """
        SELECT c.deployment_id, c.artifact_id, c.role, c.target_kind, c.target_id, list_sort(list(DISTINCT c.claim_chunk_content_hash) FILTER (WHERE c.claim_chunk_content_hash IS NOT NULL)) AS claim_chunk_content_hashes, count(*) AS link_count
        FROM v_page_citations c JOIN knowledge_artifacts a ON a.artifact_id = c.artifact_id AND a.status <> 'tombstoned' GROUP BY ALL""",
    "v_changes_visible": """
        WITH f AS (SELECT *, coalesce(fact_label, predicate, statement) AS label FROM v_fact_visible)
        SELECT deployment_id, fact_kind || '_ingest' AS object_kind, fact_id AS event_id, fact_id AS object_id, ingested_at AS occurred_at, label FROM f
        UNION ALL SELECT deployment_id, fact_kind || '_invalidation', fact_id, fact_id, invalidated_at, label FROM f WHERE invalidated_at IS NOT NULL
        UNION ALL SELECT f.deployment_id, 'relation_supersession', a.adjudication_id, f.fact_id, a.decided_at, label FROM f JOIN relation_adjudications a ON f.fact_kind = 'relation' AND a.relation_id = f.fact_id WHERE a.outcome = 'supersede'
        UNION ALL SELECT f.deployment_id, 'observation_supersession', a.adjudication_id, f.fact_id, a.decided_at, label FROM f JOIN observation_adjudications a ON f.fact_kind = 'observation' AND a.observation_id = f.fact_id WHERE a.outcome = 'supersede'
        UNION ALL SELECT deployment_id, 'claim_ingest', claim_id, claim_id, ingested_at, substr(claim_text, 1, 120) FROM v_claims_visible_history
        UNION ALL SELECT k.deployment_id, 'knowledge_page_compilation', k.compilation_id, p.artifact_id, k.compiled_at, p.git_path FROM knowledge_compilations k JOIN v_pages_live p USING (artifact_id)""",
}


#: Worked out once where a statement reads them more than once.
STORED = ("v_documents_live", "v_chunks_live", "v_survivors", "v_mention_current_content", "v_entity_document_mentions", "v_fact_visible", "v_claims_visible_history", "v_entities_current", "v_lineages", "v_page_citations", "v_pages_live", "v_page_evidence_visible")


def oracle(select: str, **more: str) -> str:
    """select over base tables, views (v_<name>) and further common table expressions."""
    parts = [f"{n} AS MATERIALIZED ({q})" if n in STORED else f"{n} AS ({q})" for n, q in (VIEWS | more).items()]
    if select.lstrip().startswith("WITH"):
        select = f"SELECT * FROM ({select})"
    return f"WITH RECURSIVE {duckdb_tables()},\n" + ",\n".join(parts) + f"\n{select}"
