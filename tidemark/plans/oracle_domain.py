"""The same domain as DuckDB common table expressions."""

CTES = {
    "sold": "SELECT l.*, o_custkey, o_orderdate FROM lineitem l JOIN orders ON l_orderkey = o_orderkey",
    "links": """SELECT p_partkey AS link_id, p_name AS title, f.created_at, p_brand AS brand
        FROM part JOIN (SELECT l_partkey, min(o_orderdate) AS created_at FROM sold GROUP BY 1) f ON f.l_partkey = p_partkey""",
    "labelled": """SELECT p_partkey AS link_id, p_type || '.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS topic,
        0.5::DOUBLE + (p_size % 50) / 100.0::DOUBLE AS p FROM part""",
    "suggestions": """SELECT DISTINCT l_partkey AS link_id, CASE WHEN l_quantity < 25 THEN topic ELSE split_part(topic, '.', 1) || '.Own' END AS topic,
        o_custkey AS suggested_by, 0.9::DOUBLE AS p FROM sold JOIN labelled ON link_id = l_partkey WHERE l_linenumber = 7""",
    "votes": "SELECT o_custkey AS voter, l_partkey AS link_id, min(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS value FROM sold GROUP BY 1, 2",
    "overrides": "SELECT c_custkey AS user_id, 'STANDARD' AS topic_id, (c_custkey % 10) / 10.0::DOUBLE AS score FROM customer WHERE c_custkey % 3 = 1",
    "entities": """SELECT s_suppkey AS entity_id, s_name AS name, replace(r_name, ' ', '_') || '.' || n_name AS kind_path
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "mentions": """SELECT l_partkey AS link_id, l_suppkey AS entity_id, 0.5::DOUBLE + max(l_discount) AS p, min(l_linenumber) <= 2 AS in_title
        FROM lineitem GROUP BY 1, 2""",
    "evidence": """SELECT l_suppkey AS subject, l_partkey AS object, l_linestatus AS relation, l_discount * 5 + 0.1::DOUBLE AS p,
        l_returnflag AS status, l_shipdate AS created_at, l_orderkey * 10 + l_linenumber AS seq FROM lineitem""",
    "calendar": """SELECT l_orderkey * 10 + l_linenumber AS event_id, l_partkey AS link_id,
        CASE WHEN (l_orderkey * 10 + l_linenumber) % 11 <> 0 THEN CAST(l_shipdate AS DATE) END AS starts_on,
        CASE WHEN (l_orderkey * 10 + l_linenumber) % 3 = 0 THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS ends_on,
        CASE WHEN (l_orderkey * 10 + l_linenumber) % 2 = 0 THEN ((l_orderkey * 10 + l_linenumber) % 24)::INTEGER END AS start_hour FROM lineitem""",
    "effective": """SELECT v.voter, v.link_id, v.value, s.topic, s.p FROM votes v JOIN labelled s USING (link_id)
        WHERE NOT EXISTS (SELECT 1 FROM suggestions o WHERE o.suggested_by = v.voter AND o.link_id = v.link_id AND o.topic = s.topic)
        UNION ALL SELECT v.voter, v.link_id, v.value, o.topic, o.p FROM votes v JOIN suggestions o ON o.link_id = v.link_id AND o.suggested_by = v.voter""",
    "rolled": "SELECT e.*, array_to_string(string_split(topic, '.')[1:n], '.') AS topic_id FROM effective e, unnest(range(1, len(string_split(topic, '.')) + 1)) t(n)",
    "preferences": """SELECT voter, topic_id, coalesce(sum(p) FILTER (value = 1), 0) AS likes, coalesce(sum(p) FILTER (value = -1), 0) AS dislikes,
        count(DISTINCT link_id) AS n_votes, count(DISTINCT link_id) FILTER (value = 1) AS n_up, count(DISTINCT link_id) FILTER (value = -1) AS n_down
        FROM rolled GROUP BY 1, 2""",
    "mine": """SELECT topic_id, score FROM overrides WHERE user_id = 1 UNION ALL
        SELECT topic_id, (1 + likes) / (2 + likes + dislikes) FROM preferences WHERE voter = 1 AND topic_id NOT IN (SELECT topic_id FROM overrides WHERE user_id = 1)""",
    "seen_labels": """SELECT link_id, topic, p FROM labelled l WHERE NOT EXISTS (SELECT 1 FROM suggestions s WHERE s.suggested_by = 1 AND s.link_id = l.link_id AND s.topic = l.topic)
        UNION ALL SELECT link_id, topic, p FROM suggestions WHERE suggested_by = 1""",
    "taste": """SELECT link_id, sum(p * coalesce((SELECT arg_max(score, len(topic_id)) FROM mine WHERE topic = topic_id OR starts_with(topic, topic_id || '.')), 0.5)) / sum(p) AS taste
        FROM seen_labels GROUP BY 1""",
    "counted": "SELECT link_id, count(*) FILTER (value = 1) AS ups, count(*) FILTER (value = -1) AS downs FROM votes GROUP BY 1",
    "ranked": """SELECT l.link_id, l.created_at, coalesce(taste, 0.5) * (1 + coalesce(ups, 0)) / (2 + coalesce(ups, 0) + coalesce(downs, 0))
        * power(0.5, least(date_diff('microsecond', l.created_at, TIMESTAMP '2001-12-31') / 86400000000.0 / 365, 1000)) AS rank
        FROM links l LEFT JOIN taste USING (link_id) LEFT JOIN counted USING (link_id) WHERE l.created_at <= TIMESTAMP '2001-12-31'""",
}


def sql(body: str) -> str:
    """The query with those expressions in front of it that it needs, directly or not."""
    import re

    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    head = ", ".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    extra = body.lstrip()
    if extra.upper().startswith("WITH "):
        return f"WITH {head}, {extra[5:]}" if head else extra
    return f"WITH {head} {extra}" if head else extra
