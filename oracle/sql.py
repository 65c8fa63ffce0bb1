"""DuckDB SQL for every registered query, written from the data model, not from the plans.

Each query starts from common table expressions that derive the model from the test tables.
"""

TOPICS = """topics AS (
  SELECT 'topic:' || name AS topic_id, name, order_index
  FROM (VALUES ('Self Management', 1), ('Yoga', 2), ('Relationship', 3), ('Karma', 4),
               ('Diet For Happiness', 5), ('Habits For Happiness', 6),
               ('The Perfect Knowledge', 7), ('The Real Freedom', 8)) AS v(name, order_index))"""


def marks_cte(name: str, condition: str) -> str:
    return f"""{name} AS (
  SELECT CAST(CAST(ts AS DATE) AS VARCHAR) || '|' || user_id AS mark_id,
         CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, user_id AS member_id,
         CASE WHEN event_type IN ('purchase', 'view') THEN 'present' ELSE 'absent' END AS status,
         CAST(event_id % (SELECT count(*) FROM supplier) AS VARCHAR) AS marked_by, ts AS marked_at
  FROM events WHERE {condition}
  QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1)"""


def bridge_cte(name: str, priorities: str) -> str:
    return f"""{name}_members AS (
  SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS {name}_id, o_custkey AS member_id,
         TIMESTAMP '2024-01-01 00:00:00' AS added_at
  FROM orders WHERE o_orderpriority {priorities}),
{name}s AS (
  SELECT DISTINCT {name}_id, CAST({name}_id AS DATE) AS {name}_date, CAST(NULL AS VARCHAR) AS details,
         CAST(NULL AS VARCHAR) AS created_by, TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM {name}_members)"""


BASE = f"""WITH {TOPICS},
members AS (
  SELECT *,
         CASE WHEN member_type = 'studying' THEN 'College ' || nation END AS college_name,
         CASE WHEN member_type = 'studying' THEN 'Branch ' || nation END AS branch,
         CASE WHEN member_type = 'studying' THEN CAST(member_id % 8 + 1 AS INT) END AS semester,
         CASE WHEN member_type = 'working' THEN 'Company ' || nation END AS company_name,
         CASE WHEN member_type = 'working' THEN 'Role ' || nation END AS designation,
         CASE WHEN member_type = 'working' THEN CAST(member_id % 12 AS DOUBLE) END AS experience,
         CASE WHEN member_type = 'not_studying_not_working' THEN 'Preparing ' || nation END AS description,
         TRUE AS active,
         CASE WHEN member_id % 10 = 3 THEN 2 ELSE 1 END AS level,
         CAST(NULL AS TIMESTAMP) AS promoted_at,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM (SELECT c_custkey AS member_id, c_name AS full_name, CAST(NULL AS VARCHAR) AS email,
               printf('900%07d', c_custkey) AS phone, CAST(18 + c_custkey % 40 AS INT) AS age,
               CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'studying'
                    WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'working'
                    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'not_studying_not_working' END AS member_type,
               c_nationkey AS nation
        FROM customer)),
sessions AS (
  SELECT CAST(d AS VARCHAR) AS session_id, d AS session_date, dayname(d) AS day_of_week,
         CASE WHEN d <> DATE '2024-01-15' THEN t.topic_id END AS topic_id,
         CAST(NULL AS VARCHAR) AS created_by, TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)
  JOIN topics t ON t.order_index = (date_diff('day', DATE '2024-01-01', d) + 6) % 8 + 1),
{marks_cte("marks", "TRUE")},
{bridge_cte("outing", "IN ('1-URGENT', '3-MEDIUM', '5-LOW')")},
{bridge_cte("service", "NOT IN ('1-URGENT', '3-MEDIUM', '5-LOW')")},
stage2_roster AS (
  SELECT 'roster:' || member_id AS roster_id, member_id, TIMESTAMP '2024-01-01 00:00:00' AS added_at
  FROM members WHERE level = 2),
stage2_sessions AS (
  SELECT session_id, session_date, day_of_week, created_by, created_at FROM sessions WHERE day_of_week = 'Sunday'),
stage2_marks AS (
  SELECT k.* FROM marks k JOIN stage2_sessions USING (session_id)
  WHERE k.member_id IN (SELECT member_id FROM stage2_roster)),
markers AS (SELECT CAST(s_suppkey AS VARCHAR) AS marker_id, s_name AS name FROM supplier)"""


def coverage_cte(name: str, marks: str = "marks", sessions: str = "sessions") -> str:
    return f"""{name} AS (
  SELECT k.member_id, count(DISTINCT t.topic_id) AS n
  FROM {marks} k JOIN {sessions} s USING (session_id) JOIN topics t ON t.topic_id = s.topic_id
  WHERE k.status = 'present' GROUP BY k.member_id)"""


def lapsed_cte(name: str, marks: str = "marks", sessions: str = "sessions") -> str:
    return f"""{name} AS (
  SELECT member_id, count(*) = 4 AND count(*) FILTER (WHERE status = 'absent') = 4 AS lapsed
  FROM (SELECT k.member_id, k.status, row_number() OVER (
          PARTITION BY k.member_id ORDER BY s.session_date DESC, k.marked_at DESC) AS rn
        FROM {marks} k JOIN {sessions} s USING (session_id))
  WHERE rn <= 4 GROUP BY member_id)"""


def complete_cte(name: str, coverage: str, outing: str = "outing_members", service: str = "service_members") -> str:
    return f"""{name} AS (
  SELECT member_id FROM {coverage} WHERE n = (SELECT count(*) FROM topics)
    AND member_id IN (SELECT member_id FROM {outing}) AND member_id IN (SELECT member_id FROM {service}))"""


PROMOTE = """
    CASE WHEN level < 2 AND member_id IN (SELECT member_id FROM {0}) THEN 2 ELSE level END AS level,
    CASE WHEN level < 2 AND member_id IN (SELECT member_id FROM {0})
         THEN coalesce(promoted_at, TIMESTAMP '2024-02-01 09:00:00') ELSE promoted_at END AS promoted_at"""

STATE = f"""{BASE},
{coverage_cte("coverage")},
{lapsed_cte("lapsed")},
{complete_cte("complete", "coverage")},
state AS (
  SELECT * REPLACE (
    CASE WHEN level = 1 THEN member_id NOT IN (SELECT member_id FROM lapsed WHERE lapsed) ELSE active END AS active,
    {PROMOTE.format("complete")})
  FROM members)"""

MEMBER = """member_id, full_name, email, phone, age, member_type, college_name, branch, semester,
  company_name, designation, experience, description, active, level,
  CAST(promoted_at AS VARCHAR) AS promoted_at, CAST(created_at AS VARCHAR) AS created_at"""

MEMBER_OF_P = ", ".join(
    f"CAST(m.{c} AS VARCHAR) AS {c}" if c.endswith("_at") else f"m.{c}"
    for c in ("member_id full_name email phone age member_type college_name branch semester company_name designation "
              "experience description active level promoted_at created_at").split()
)

MARK = "mark_id, session_id, member_id, status, marked_by, CAST(marked_at AS VARCHAR) AS marked_at"


def all_pairs(attended: str) -> str:
    """Attended (member, topic) pairs."""
    return f"""{attended} AS (
  SELECT DISTINCT k.member_id, s.topic_id FROM marks k JOIN sessions s USING (session_id)
  WHERE k.status = 'present' AND s.topic_id IS NOT NULL)"""


def summary_sql(condition: str) -> str:
    return f"""{BASE}
SELECT m.member_id, m.full_name, count(k.mark_id) AS total_sessions,
       count(*) FILTER (WHERE k.status = 'present') AS present_count,
       count(*) FILTER (WHERE k.status = 'absent') AS absent_count,
       CASE WHEN count(k.mark_id) > 0
            THEN ((20000 * count(*) FILTER (WHERE k.status = 'present') + count(k.mark_id)) // (2 * count(k.mark_id))) / 100.0
            ELSE 0.0 END AS attendance_percentage
FROM members m LEFT JOIN (
  SELECT k.* FROM marks k JOIN sessions s USING (session_id) WHERE {condition}) k ON k.member_id = m.member_id
WHERE m.level = 1 GROUP BY m.member_id, m.full_name"""


def log_sql(marks: str, sessions: str, condition: str = "TRUE") -> str:
    return f"""{BASE}
SELECT k.mark_id, k.status, CAST(k.marked_at AS VARCHAR) AS marked_at, s.session_id,
       CAST(s.session_date AS VARCHAR) AS session_date, s.day_of_week, m.member_id,
       m.full_name AS member_name, u.name AS marked_by_name
FROM {marks} k JOIN {sessions} s USING (session_id) JOIN members m ON m.member_id = k.member_id
LEFT JOIN markers u ON u.marker_id = k.marked_by WHERE {condition}"""


def sessions_sql(condition: str) -> str:
    return f"""{BASE}
SELECT s.session_id, CAST(s.session_date AS VARCHAR) AS session_date, s.day_of_week, s.created_by,
       CAST(s.created_at AS VARCHAR) AS created_at, t.topic_id, t.name AS topic_name
FROM sessions s LEFT JOIN topics t ON t.topic_id = s.topic_id WHERE {condition}"""


def history_sql(name: str) -> str:
    return f"""{BASE}
SELECT b.member_id, CAST(e.{name}_date AS VARCHAR) AS {name}_date, e.details,
       CAST(b.added_at AS VARCHAR) AS recorded_at
FROM {name}_members b JOIN {name}s e USING ({name}_id)"""


def list_events_sql(name: str, extra: str = "") -> str:
    return f"""{BASE}
SELECT e.{name}_id, CAST(e.{name}_date AS VARCHAR) AS {name}_date, e.details,
       CAST(e.created_at AS VARCHAR) AS created_at, count(b.member_id) AS participant_count{extra}
FROM {name}s e LEFT JOIN {name}_members b USING ({name}_id) GROUP BY ALL"""


def participants_sql(name: str) -> str:
    return f"""{BASE}
SELECT e.{name}_id, CAST(e.{name}_date AS VARCHAR) AS {name}_date, m.member_id, m.full_name, m.phone
FROM {name}_members b JOIN {name}s e USING ({name}_id) JOIN members m ON m.member_id = b.member_id"""


def eligible_sql(comparison: str) -> str:
    return f"""{STATE}
SELECT st.member_id, st.full_name, st.phone, count(DISTINCT t.topic_id) AS attended_topics
FROM state st LEFT JOIN marks k ON k.member_id = st.member_id AND k.status = 'present'
LEFT JOIN sessions s ON s.session_id = k.session_id LEFT JOIN topics t ON t.topic_id = s.topic_id
WHERE st.level = 1 GROUP BY ALL HAVING count(DISTINCT t.topic_id) {comparison} 4"""


COUNTS = f"""{BASE},
{coverage_cte("coverage")},
counts AS (
  SELECT m.member_id, m.full_name, m.level, coalesce(c.n, 0) AS attended_topics,
         (SELECT count(DISTINCT outing_id) FROM outing_members o WHERE o.member_id = m.member_id) AS outing_count,
         (SELECT count(DISTINCT service_id) FROM service_members v WHERE v.member_id = m.member_id) AS service_count,
         (SELECT count(*) FROM topics) AS total_topics
  FROM members m LEFT JOIN coverage c ON c.member_id = m.member_id),
parts AS (
  SELECT *, list_filter([
      CASE WHEN total_topics > attended_topics THEN 'Needs to attend ' || (total_topics - attended_topics)
        || ' more class' || CASE WHEN total_topics - attended_topics = 1 THEN '' ELSE 'es' END END,
      CASE WHEN outing_count = 0 THEN 'Needs to attend one trip' END,
      CASE WHEN service_count = 0 THEN 'Needs to volunteer once' END], lambda x: x IS NOT NULL) AS missing_list
  FROM counts),
statuses AS (
  SELECT member_id, full_name, level, level >= 2 AS promoted, attended_topics, total_topics, outing_count, service_count,
         coalesce(array_to_string(missing_list, '|'), '') AS missing,
         CASE WHEN level >= 2 THEN 'Promoted' WHEN len(missing_list) > 0 THEN array_to_string(missing_list, ', ')
              ELSE 'Eligible for promotion' END AS summary
  FROM parts)"""

PROGRESS = """progress AS (
  SELECT m.member_id, t.topic_id, t.name, t.order_index,
         CASE WHEN count(k.mark_id) = 0 THEN 'absent' ELSE 'present' END AS status,
         CAST(max(s.session_date) AS VARCHAR) AS attended_on,
         coalesce(string_agg(CAST(s.session_date AS VARCHAR), '|' ORDER BY s.session_date)
                  FILTER (WHERE k.mark_id IS NOT NULL), '') AS attended_dates,
         CAST(max(s.session_date) FILTER (WHERE k.mark_id IS NOT NULL) AS VARCHAR) AS last_attended_on
  FROM members m CROSS JOIN topics t LEFT JOIN sessions s ON s.topic_id = t.topic_id
  LEFT JOIN marks k ON k.session_id = s.session_id AND k.member_id = m.member_id AND k.status = 'present'
  GROUP BY m.member_id, t.topic_id, t.name, t.order_index)"""


def joined_history(name: str) -> str:
    return f"""(SELECT coalesce(string_agg({name}_id || '=' || CAST(added_at AS VARCHAR) || '=', '|' ORDER BY {name}_id DESC), '')
        FROM {name}_members h WHERE h.member_id = p.member_id)"""


READS = {
    "all_members_report": f"""{STATE},
{all_pairs("attended")}
SELECT st.member_id, st.full_name, st.phone,
       string_agg(t.name || '=' || CASE WHEN a.member_id IS NULL THEN 'Not Attended' ELSE 'Attended' END,
                  '|' ORDER BY t.order_index) AS topics,
       CASE WHEN st.member_id IN (SELECT member_id FROM outing_members) THEN 'Attended' ELSE 'Not Attended' END AS outing,
       CASE WHEN st.member_id IN (SELECT member_id FROM service_members) THEN 'Done' ELSE 'Not Done' END AS service,
       CASE WHEN st.active THEN 'Active' ELSE 'Inactive' END AS activity_status,
       CASE WHEN st.level >= 2 THEN 'Promoted' ELSE 'Not Promoted' END AS promotion_status
FROM state st CROSS JOIN topics t
LEFT JOIN attended a ON a.member_id = st.member_id AND a.topic_id = t.topic_id
GROUP BY st.member_id, st.full_name, st.phone, st.active, st.level""",
    "list_members": f"{STATE} SELECT {MEMBER} FROM state WHERE level = 1",
    "list_members_inactive_any_level": f"{STATE} SELECT {MEMBER} FROM state WHERE active = FALSE",
    "list_members_eligible": f"""{STATE} SELECT {MEMBER} FROM state WHERE level = 1 AND (
  SELECT count(DISTINCT t.topic_id) FROM marks k JOIN sessions s USING (session_id)
  JOIN topics t ON t.topic_id = s.topic_id
  WHERE k.member_id = state.member_id AND k.status = 'present') >= 4""",
    "member_by_id": f"{BASE} SELECT {MEMBER} FROM members WHERE member_id IN (SELECT s_suppkey FROM supplier)",
    "member_topic_progress": f"{BASE}, {PROGRESS} SELECT * FROM progress",
    "member_outing_history": history_sql("outing"),
    "member_service_history": history_sql("service"),
    "member_progress_counts": f"""{COUNTS}
SELECT member_id, attended_topics, outing_count, service_count, total_topics FROM counts""",
    "promotion_status": f"""{COUNTS}
SELECT member_id, promoted, attended_topics, total_topics, outing_count, service_count, missing, summary FROM statuses""",
    "member_details": f"""{COUNTS}, {PROGRESS}
SELECT {MEMBER_OF_P},
       (SELECT string_agg(concat_ws('=', topic_id, name, order_index, status, coalesce(attended_on, ''), replace(attended_dates, '|', ','),
                                    coalesce(last_attended_on, '')), '|' ORDER BY order_index)
        FROM progress g WHERE g.member_id = p.member_id) AS sessions,
       {joined_history("outing")} AS outings, {joined_history("service")} AS services,
       p.promoted, p.attended_topics, p.total_topics, p.outing_count, p.service_count, p.missing, p.summary
FROM statuses p JOIN members m ON m.member_id = p.member_id""",
    "list_sessions": sessions_sql("TRUE"),
    "list_sessions_range": sessions_sql("s.session_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"),
    "list_marks": log_sql("marks", "sessions"),
    "list_marks_of_date": log_sql("marks", "sessions", "s.session_date = DATE '2024-01-14'"),
    "attendance_summary": summary_sql("TRUE"),
    "attendance_summary_range": summary_sql("s.session_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"),
    "inactive_report": f"""{STATE},
last_present AS (
  SELECT k.member_id, CAST(s.session_date AS VARCHAR) AS session_date, t.name AS topic_name,
         row_number() OVER (PARTITION BY k.member_id ORDER BY s.session_date DESC, k.marked_at DESC) AS rn
  FROM marks k JOIN sessions s USING (session_id) LEFT JOIN topics t ON t.topic_id = s.topic_id
  WHERE k.status = 'present')
SELECT st.member_id, st.full_name, st.phone, lp.topic_name, lp.session_date
FROM state st LEFT JOIN last_present lp ON lp.member_id = st.member_id AND lp.rn = 1
WHERE st.active = FALSE AND st.level = 1""",
    "eligible_report": eligible_sql(">="),
    "not_eligible_report": eligible_sql("<"),
    "promoted_report": f"""{STATE}
SELECT st.member_id, st.full_name, st.phone, CAST(st.promoted_at AS VARCHAR) AS promoted_at,
       (SELECT CAST(max(o.outing_date) AS VARCHAR) FROM outing_members b JOIN outings o USING (outing_id)
        WHERE b.member_id = st.member_id) AS outing_date
FROM state st WHERE st.member_id IN (SELECT member_id FROM complete)""",
    "missing_by_topic": f"""{STATE},
{all_pairs("attended")}
SELECT t.topic_id, t.name, t.order_index, st.member_id, st.full_name, st.phone
FROM topics t CROSS JOIN state st
WHERE st.level = 1 AND NOT EXISTS (
  SELECT 1 FROM attended a WHERE a.member_id = st.member_id AND a.topic_id = t.topic_id)""",
    "missing_counts_by_topic": f"""{STATE},
{all_pairs("attended")}
SELECT t.topic_id, t.name, t.order_index, count(*) FILTER (WHERE a.member_id IS NULL) AS missing_count
FROM topics t CROSS JOIN (SELECT * FROM state WHERE level = 1) st
LEFT JOIN attended a ON a.member_id = st.member_id AND a.topic_id = t.topic_id GROUP BY ALL""",
    "yet_to_outing": f"""{STATE}
SELECT st.member_id, st.full_name, st.phone, c.n AS attended_topics
FROM state st JOIN coverage c ON c.member_id = st.member_id
WHERE c.n >= 4 AND st.level = 1 AND st.member_id NOT IN (SELECT member_id FROM outing_members)""",
    "yet_to_service": f"""{STATE}
SELECT member_id, full_name, phone FROM state WHERE member_id NOT IN (SELECT member_id FROM service_members)""",
    "list_outings": list_events_sql("outing", ", FALSE AS is_locked"),
    "outing_participants": participants_sql("outing"),
    "list_services": list_events_sql("service"),
    "service_participants": participants_sql("service"),
    "stage2_members": f"{BASE} SELECT {MEMBER} FROM members WHERE member_id IN (SELECT member_id FROM stage2_roster)",
    "stage2_member_by_id": f"""{BASE} SELECT {MEMBER} FROM members
WHERE member_id IN (SELECT member_id FROM stage2_roster) AND member_id IN (SELECT s_suppkey FROM supplier)""",
    "stage2_member_history": f"""{BASE}
SELECT r.member_id, CAST(s.session_date AS VARCHAR) AS session_date, coalesce(k.status, 'absent') AS status,
       CAST(k.marked_at AS VARCHAR) AS marked_at
FROM stage2_roster r CROSS JOIN stage2_sessions s
LEFT JOIN stage2_marks k ON k.session_id = s.session_id AND k.member_id = r.member_id
WHERE r.member_id IN (SELECT s_suppkey FROM supplier)""",
    "stage2_member_marks": f"""{BASE}
SELECT k.member_id, CAST(s.session_date AS VARCHAR) AS session_date, k.status, CAST(k.marked_at AS VARCHAR) AS marked_at
FROM stage2_marks k JOIN stage2_sessions s USING (session_id)""",
    "stage2_member_absences": f"""{BASE}
SELECT r.member_id, count(k.mark_id) AS marked, (SELECT count(*) FROM stage2_sessions) - count(k.mark_id) AS implied_absences
FROM stage2_roster r LEFT JOIN stage2_marks k ON k.member_id = r.member_id GROUP BY r.member_id""",
    "list_members_active": f"{STATE} SELECT {MEMBER} FROM state WHERE active AND level = 1",
    "list_marks_of_session": log_sql("marks", "sessions", "s.session_id = '2024-01-14'"),
    "stage2_marks_of_date": log_sql("stage2_marks", "stage2_sessions", "s.session_date = DATE '2024-01-14'"),
    "stage2_marks_of_session": log_sql("stage2_marks", "stage2_sessions", "s.session_id = '2024-01-07'"),
    "stage2_sessions_range": f"""{BASE}
SELECT session_id, CAST(session_date AS VARCHAR) AS session_date, day_of_week, created_by,
       CAST(created_at AS VARCHAR) AS created_at FROM stage2_sessions
WHERE session_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    "stage2_sessions": f"""{BASE}
SELECT session_id, CAST(session_date AS VARCHAR) AS session_date, day_of_week, created_by,
       CAST(created_at AS VARCHAR) AS created_at FROM stage2_sessions""",
    "stage2_marks": log_sql("stage2_marks", "stage2_sessions"),
    "fixture_summary": f"""{BASE},
facts AS (
  SELECT m.*, coalesce((SELECT bool_and(status = 'present') FROM marks k WHERE k.member_id = m.member_id), TRUE) AS every,
         m.member_id IN (SELECT member_id FROM outing_members) AS outing,
         m.member_id IN (SELECT member_id FROM service_members) AS service
  FROM members m)
SELECT count(*) AS members, count(*) FILTER (WHERE member_type = 'studying') AS studying,
       count(*) FILTER (WHERE member_type = 'working') AS working,
       count(*) FILTER (WHERE level = 1 AND active) AS active_level1,
       count(*) FILTER (WHERE level = 1 AND NOT active) AS inactive_level1,
       count(*) FILTER (WHERE level >= 2) AS promoted,
       count(*) FILTER (WHERE level = 1 AND every AND outing AND NOT service) AS outing_only,
       count(*) FILTER (WHERE level = 1 AND every AND NOT outing AND service) AS service_only,
       count(*) FILTER (WHERE level = 1 AND NOT every AND outing AND service) AS both_missing_topics
FROM facts""",
    "ensure_topics": f"""WITH {TOPICS},
stored AS (
  SELECT 'stored:' || min(event_type) AS topic_id,
         CASE event_type WHEN 'view' THEN 'Yoga' WHEN 'click' THEN 'Karma' ELSE event_type END AS name,
         CAST(count(*) AS INT) AS order_index, '2024-01-01 00:00:00' AS created_at
  FROM events GROUP BY 2)
SELECT coalesce(s.topic_id, t.topic_id) AS topic_id, coalesce(s.name, t.name) AS name,
       coalesce(t.order_index, s.order_index) AS order_index,
       coalesce(s.created_at, '2024-02-01 09:00:00') AS created_at
FROM stored s FULL JOIN topics t ON t.name = s.name""",
    "activity_status": f"""{BASE}, {lapsed_cte("lapsed")},
changed AS (SELECT * REPLACE (CASE WHEN level = 1 THEN NOT coalesce(
    (SELECT lapsed FROM lapsed l WHERE l.member_id = members.member_id), FALSE) ELSE active END AS active) FROM members)
SELECT {MEMBER} FROM changed""",
    "activity_refresh": f"""{BASE}, {lapsed_cte("lapsed")},
changed AS (SELECT * REPLACE (CASE WHEN level = 1
    AND member_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')
    AND member_id IN (SELECT member_id FROM lapsed WHERE lapsed) THEN FALSE ELSE active END AS active) FROM members)
SELECT {MEMBER} FROM changed""",
    "latest_status": f"""{BASE}
SELECT member_id, arg_max(status, session_id) AS latest_status FROM marks GROUP BY member_id""",
    "promotion_eligible": f"{STATE} SELECT member_id FROM complete",
    "promote": f"""{STATE}, changed AS (SELECT * REPLACE ({PROMOTE.format("complete")}) FROM members)
SELECT {MEMBER} FROM changed""",
    "stage2_roster_sync": f"""{STATE}
SELECT roster_id, member_id, CAST(added_at AS VARCHAR) AS added_at FROM stage2_roster
UNION ALL SELECT 'roster:' || member_id, member_id, '2024-02-01 09:00:00' FROM state
WHERE level >= 2 AND member_id NOT IN (SELECT member_id FROM stage2_roster)""",
    "prepare_state": f"{STATE} SELECT {MEMBER} FROM state",
    "topic_rotation": f"""WITH {TOPICS},
dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT CAST(d AS VARCHAR) AS session_date, t.name AS topic_name, t.topic_id
FROM dates LEFT JOIN topics t ON dayname(d) = 'Sunday'
  AND t.order_index - 1 = ((date_diff('day', DATE '2026-05-31', d) // 7 + 6) % 8 + 8) % 8""",
    "topic_coverage": f"{STATE} SELECT member_id, n AS n_topics FROM coverage",
    "migrate_add_columns": f"""{BASE}
SELECT member_id, full_name, phone, age, member_type, active, level,
       CASE WHEN c_acctbal >= 0 THEN 'College ' || c_nationkey END AS institution_name,
       CAST(NULL AS VARCHAR) AS college_name, CAST(NULL AS VARCHAR) AS branch, CAST(NULL AS INT) AS semester,
       CAST(NULL AS VARCHAR) AS designation, CAST(NULL AS DOUBLE) AS experience, CAST(NULL AS VARCHAR) AS description
FROM members JOIN customer ON c_custkey = member_id""",
    "backfill_profile": f"""{BASE}
SELECT member_id, full_name, phone, age, member_type, active, level,
       CASE WHEN c_acctbal >= 0 THEN 'College ' || c_nationkey END AS institution_name,
       CASE WHEN c_acctbal >= 0 AND member_type = 'studying' THEN 'College ' || c_nationkey END AS college_name,
       CAST(NULL AS VARCHAR) AS branch, CAST(NULL AS INT) AS semester,
       CAST(NULL AS VARCHAR) AS designation, CAST(NULL AS DOUBLE) AS experience, CAST(NULL AS VARCHAR) AS description
FROM members JOIN customer ON c_custkey = member_id""",
}

# --- constraint check -------------------------------------------------------------------

_UNIQUE = [
    ("members", "member_id"), ("topics", "topic_id"), ("topics", "name"), ("sessions", "session_id"),
    ("sessions", "session_date"), ("marks", "mark_id"), ("marks", "session_id, member_id"),
    ("outings", "outing_id"), ("outings", "outing_date"), ("outing_members", "outing_id, member_id"),
    ("services", "service_id"), ("services", "service_date"), ("service_members", "service_id, member_id"),
    ("stage2_roster", "roster_id"), ("stage2_roster", "member_id"), ("stage2_sessions", "session_id"),
    ("stage2_sessions", "session_date"), ("stage2_marks", "mark_id"), ("stage2_marks", "session_id, member_id"),
    ("markers", "marker_id"),
]
_REQUIRED = {
    "members": "member_id, full_name, active, level, created_at",
    "topics": "topic_id, name, order_index",
    "sessions": "session_id, session_date, day_of_week, created_at",
    "marks": "mark_id, session_id, member_id, status, marked_at",
    "outings": "outing_id, outing_date, created_at",
    "outing_members": "outing_id, member_id, added_at",
    "services": "service_id, service_date, created_at",
    "service_members": "service_id, member_id, added_at",
    "stage2_roster": "roster_id, member_id, added_at",
    "stage2_sessions": "session_id, session_date, day_of_week, created_at",
    "stage2_marks": "mark_id, session_id, member_id, status, marked_at",
    "markers": "marker_id, name",
}
_REFERENCES = [
    ("sessions", "topic_id", "topics", "topic_id"), ("marks", "session_id", "sessions", "session_id"),
    ("marks", "member_id", "members", "member_id"), ("outing_members", "outing_id", "outings", "outing_id"),
    ("outing_members", "member_id", "members", "member_id"),
    ("service_members", "service_id", "services", "service_id"),
    ("service_members", "member_id", "members", "member_id"), ("stage2_roster", "member_id", "members", "member_id"),
    ("stage2_marks", "session_id", "stage2_sessions", "session_id"),
    ("stage2_marks", "member_id", "members", "member_id"), ("marks", "marked_by", "markers", "marker_id"),
    ("stage2_marks", "marked_by", "markers", "marker_id"), ("sessions", "created_by", "markers", "marker_id"),
    ("outings", "created_by", "markers", "marker_id"), ("services", "created_by", "markers", "marker_id"),
    ("stage2_sessions", "created_by", "markers", "marker_id"),
]


def _constraint_lines() -> list[str]:
    lines = [
        f"SELECT '{t}' AS table_name, 'unique {k}' AS rule, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {t})) "
        f"AS violations FROM {t}"
        for t, k in _UNIQUE
    ]
    lines.append("SELECT 'members', 'unique phone', count(phone) - count(DISTINCT phone) FROM members")
    for table, columns in _REQUIRED.items():
        condition = " OR ".join(f"{c} IS NULL" for c in columns.split(", "))
        lines.append(f"SELECT '{table}', 'required columns', count(*) FILTER (WHERE {condition}) FROM {table}")
    for table, column, other, key in _REFERENCES:
        lines.append(
            f"SELECT '{table}', '{column} in {other}', count(*) FROM {table} "
            f"WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {other})"
        )
    for table in ["marks", "stage2_marks"]:
        lines.append(f"SELECT '{table}', 'status', count(*) FROM {table} WHERE status NOT IN ('present', 'absent')")
    return lines


READS["constraint_check"] = f"{BASE} " + " UNION ALL ".join(_constraint_lines())

# --- registration -----------------------------------------------------------------------

APPLICANTS = """applicants AS (
  SELECT s_suppkey AS ord, s_suppkey + 1000000000 AS member_id,
         CASE WHEN s_nationkey = 24 THEN '  ' ELSE ' ' || s_name || ' ' END AS full_name,
         CASE WHEN s_acctbal < 1000 THEN printf('900%07d', s_suppkey)
              WHEN s_acctbal < 3000 THEN printf('800%07d', s_nationkey)
              ELSE printf(' 700%07d', s_suppkey) END AS phone,
         CAST(CAST(floor(s_acctbal / 100) AS BIGINT) AS VARCHAR) AS age,
         ['studying', 'working', 'not_studying_not_working', 'retired'][s_nationkey % 4 + 1] AS member_type,
         CASE WHEN s_nationkey = 4 THEN '' ELSE 'College ' || s_nationkey END AS college_name,
         'Branch ' || s_nationkey AS branch,
         CASE WHEN s_nationkey = 8 THEN 'two' ELSE CAST(s_nationkey % 9 AS VARCHAR) END AS semester,
         'Company ' || s_nationkey AS company_name,
         CASE WHEN s_nationkey <> 5 THEN 'Role ' || s_nationkey END AS designation,
         CASE WHEN s_nationkey = 9 THEN '-1' ELSE s_nationkey || '.5' END AS experience,
         CASE WHEN s_nationkey <> 6 THEN ' Preparing ' || s_nationkey END AS description
  FROM supplier),
alone AS (
  SELECT *, trim(phone) AS phone_key,
    CASE WHEN trim(full_name) = '' THEN 'no full_name given' END AS early,
    CASE WHEN CAST(age AS BIGINT) <= 0 THEN 'age is not above zero'
         WHEN member_type = 'retired'
           THEN 'member_type is none of the known ones'
         WHEN member_type = 'studying' AND college_name = '' THEN 'studying needs a college_name'
         WHEN member_type = 'studying' AND coalesce(TRY_CAST(semester AS INT), 0) <= 0
           THEN 'semester is not above zero'
         WHEN member_type = 'working' AND designation IS NULL THEN 'working needs a designation'
         WHEN member_type = 'working' AND CAST(experience AS DOUBLE) < 0 THEN 'experience is below zero'
         WHEN member_type = 'not_studying_not_working' AND description IS NULL
           THEN '{description}' END AS detail
  FROM applicants),
claims AS (
  SELECT phone_key, min(ord) AS winner FROM alone
  WHERE early IS NULL AND detail IS NULL AND phone_key NOT IN (SELECT phone FROM members) GROUP BY phone_key),
judged AS (
  SELECT a.*, coalesce(early, CASE WHEN a.phone_key IN (SELECT phone FROM members) OR a.ord > c.winner
      THEN 'phone number is in use' END, detail) AS reason
  FROM alone a LEFT JOIN claims c USING (phone_key))"""

NEW_MEMBER = """SELECT member_id, trim(full_name) AS full_name, CAST(NULL AS VARCHAR) AS email, phone_key AS phone,
  CAST(age AS INT) AS age, member_type,
  CASE WHEN member_type = 'studying' THEN college_name END AS college_name,
  CASE WHEN member_type = 'studying' THEN branch END AS branch,
  CASE WHEN member_type = 'studying' THEN CAST(semester AS INT) END AS semester,
  CASE WHEN member_type = 'working' THEN company_name END AS company_name,
  CASE WHEN member_type = 'working' THEN designation END AS designation,
  CASE WHEN member_type = 'working' THEN CAST(experience AS DOUBLE) END AS experience,
  CASE WHEN member_type = 'not_studying_not_working' THEN trim(description) END AS description,
  TRUE AS active, {level} AS level, {promoted} AS promoted_at, '2024-02-01 09:00:00' AS created_at
FROM judged WHERE reason IS NULL"""

REGISTER = f"{BASE}, {APPLICANTS.format(description='not_studying_not_working needs a description')}"
REGISTER2 = f"{BASE}, {APPLICANTS.format(description='a stage-2 member without studies or work needs a description')}"

PATCHES = """patches AS (
  SELECT c_custkey AS ord, CASE WHEN c_nationkey = 3 THEN -1 - c_custkey ELSE c_custkey END AS member_id,
         CASE WHEN c_acctbal < 6000 THEN 'Renamed ' || c_name END AS full_name,
         CASE WHEN c_acctbal < 0 THEN printf('900%07d', c_custkey + 1)
              WHEN c_acctbal < 1000 THEN printf('600%07d', c_nationkey)
              WHEN c_acctbal < 1500 THEN printf('900%07d', c_custkey) END AS phone,
         CASE WHEN c_acctbal > 9000 THEN 0 WHEN c_acctbal > 7000 THEN 44 END AS age,
         CASE WHEN c_acctbal >= 2000 THEN CASE
              WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'working'
              WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'not_studying_not_working'
              ELSE 'studying' END END AS member_type,
         c_acctbal >= 5000 AS complete_patch, c_nationkey AS nation, c_acctbal AS balance
  FROM customer),
checked AS (
  SELECT p.*,
    EXISTS (SELECT 1 FROM members m WHERE m.phone = p.phone AND m.member_id <> p.member_id) AS taken,
    CASE WHEN age = 0 THEN 'age is not above zero'
         WHEN nation = 7 AND balance < 2000 THEN 'profile columns come without a member_type'
         WHEN member_type = 'studying' AND complete_patch AND nation = 0 THEN 'semester is not above zero'
         WHEN member_id NOT IN (SELECT member_id FROM members) THEN 'member not found' END AS detail
  FROM patches p),
phone_claims AS (
  SELECT phone, arg_min(member_id, ord) AS winner FROM checked
  WHERE phone IS NOT NULL AND NOT taken AND detail IS NULL GROUP BY phone),
judged AS (
  SELECT c.*, CASE WHEN taken OR w.winner <> c.member_id THEN 'phone number is in use'
              ELSE detail END AS reason
  FROM checked c LEFT JOIN phone_claims w ON w.phone = c.phone),
good AS (SELECT * FROM judged WHERE reason IS NULL)"""


def patched_profile(column: str, kind: str, value: str) -> str:
    return f"""CASE WHEN g.member_type = '{kind}' THEN {value}
       WHEN g.member_type IS NOT NULL THEN NULL ELSE m.{column} END AS {column}"""


REGISTRATION = {
    "validate_members": f"""{REGISTER}
SELECT ord, CASE WHEN early IS NULL AND detail IS NULL THEN trim(full_name) ELSE full_name END AS full_name,
       CASE WHEN early IS NULL AND detail IS NULL THEN phone_key ELSE phone END AS phone, age,
       coalesce(early, detail) AS reason FROM alone""",
    "duplicate_phone": f"""{REGISTER}
SELECT ord, phone, reason FROM judged WHERE reason = 'phone number is in use'""",
    "create_members": f"""{REGISTER} SELECT {MEMBER} FROM members
UNION ALL {NEW_MEMBER.format(level=1, promoted="CAST(NULL AS VARCHAR)")}""",
    "create_members_rejected": f"{REGISTER} SELECT ord, reason FROM judged WHERE reason IS NOT NULL",
    "create_stage2_members": f"""{REGISTER2} SELECT {MEMBER} FROM members
UNION ALL {NEW_MEMBER.format(level=2, promoted="'2024-02-01 09:00:00'")}""",
    "create_stage2_members_roster": f"""{REGISTER2}
SELECT roster_id, member_id, CAST(added_at AS VARCHAR) AS added_at FROM stage2_roster
UNION ALL SELECT 'roster:' || member_id, member_id, '2024-02-01 09:00:00' FROM judged WHERE reason IS NULL""",
    "patch_members": f"""{BASE}, {PATCHES}
SELECT m.member_id, coalesce(g.full_name, m.full_name) AS full_name, m.email, coalesce(g.phone, m.phone) AS phone,
  coalesce(g.age, m.age) AS age, coalesce(g.member_type, m.member_type) AS member_type,
  {patched_profile("college_name", "studying", "CASE WHEN complete_patch THEN 'New College ' || g.nation END")},
  {patched_profile("branch", "studying", "CASE WHEN complete_patch THEN 'New Branch ' || g.nation END")},
  {patched_profile("semester", "studying", "CASE WHEN complete_patch THEN g.nation END")},
  {patched_profile("company_name", "working", "CASE WHEN complete_patch THEN 'New Company ' || g.nation END")},
  {patched_profile("designation", "working", "NULL")},
  {patched_profile("experience", "working", "CASE WHEN complete_patch THEN g.nation + 0.25 END")},
  {patched_profile("description", "not_studying_not_working", "'Now ' || g.nation")},
  m.active, m.level, CAST(m.promoted_at AS VARCHAR) AS promoted_at, CAST(m.created_at AS VARCHAR) AS created_at
FROM members m LEFT JOIN good g ON g.member_id = m.member_id""",
    "patch_members_rejected": f"{BASE}, {PATCHES} SELECT ord, member_id, reason FROM judged WHERE reason IS NOT NULL",
    "set_active": f"""{BASE},
changed AS (SELECT m.* REPLACE (CASE WHEN c_nationkey <> 7 THEN c_acctbal >= 0 ELSE active END AS active)
  FROM members m JOIN customer ON c_custkey = member_id)
SELECT {MEMBER} FROM changed""",
    "set_active_rejected": """
SELECT c_custkey AS member_id, 'active is required' AS reason FROM customer WHERE c_nationkey = 7
UNION ALL SELECT -1 - s_suppkey, 'member not found' FROM supplier""",
    "delete_members": f"""{BASE} SELECT {MEMBER} FROM members
WHERE member_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    "delete_members_removed": f"""{BASE}
SELECT c_custkey AS member_id, (SELECT count(*) FROM marks k WHERE k.member_id = c_custkey) AS attendance_removed
FROM customer WHERE c_acctbal < 0""",
    "delete_members_marks": f"""{BASE} SELECT {MARK} FROM marks
WHERE member_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    **{
        f"delete_members_{table}": f"""{BASE} SELECT * REPLACE (CAST({at} AS VARCHAR) AS {at}) FROM {table}
WHERE member_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
        for table, at in [("outing_members", "added_at"), ("service_members", "added_at"), ("stage2_roster", "added_at"), ("stage2_marks", "marked_at")]
    },
    "delete_members_rejected": "SELECT -1 - s_suppkey AS member_id, 'member not found' AS reason FROM supplier",
}

# --- sessions and marks -----------------------------------------------------------------

SESSION_REQUESTS = """asked AS (
  SELECT d, date_diff('day', DATE '1970-01-01', d) AS ord,
         CASE WHEN day(d) = 31 THEN strftime(d, '%Y/%m/%d') ELSE CAST(d AS VARCHAR) END AS session_date
  FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events UNION SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders)),
judged AS (
  SELECT *, CASE WHEN day(d) = 31 THEN 'session_date must be a valid date'
                 WHEN dayname(d) <> 'Sunday' THEN 'sessions are only on the session weekday'
                 WHEN d > DATE '2024-01-20' THEN 'the date is still to come' END AS reason
  FROM asked)"""

FEED = f"""{marks_cte("stored_marks", "hour(ts) < 12")},
feed AS (
  SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS seq,
         CAST(CAST(ts AS DATE) AS VARCHAR) || '#' || hour(ts) AS batch_id, event_id AS ord,
         CAST(CAST(ts AS DATE) AS VARCHAR) AS session_date, user_id,
         CASE WHEN event_type = 'error' AND value > 260 THEN -1 ELSE user_id END AS member_id,
         CASE WHEN event_type = 'signup' AND value > 200 THEN 'late'
              WHEN event_type IN ('purchase', 'view') THEN 'present' ELSE 'absent' END AS status,
         CAST(event_id % (SELECT count(*) FROM supplier) AS VARCHAR) AS marked_by, ts AS received_at,
         event_type, value
  FROM events),
bad AS (
  SELECT batch_id, arg_min(CASE WHEN status = 'late' THEN 'a status is neither present nor absent'
                                ELSE 'unknown member_id' END, ord) AS reason
  FROM feed WHERE status = 'late' OR member_id = -1 GROUP BY batch_id),
latest AS (
  SELECT * FROM feed WHERE batch_id NOT IN (SELECT batch_id FROM bad)
  QUALIFY row_number() OVER (PARTITION BY session_date, member_id ORDER BY seq DESC, ord DESC) = 1),
new_sessions AS (
  SELECT s.* REPLACE (CASE WHEN s.session_id IN (SELECT session_date FROM latest) THEN t.topic_id
                           ELSE s.topic_id END AS topic_id)
  FROM sessions s JOIN topics t ON t.order_index = (date_diff('day', DATE '2024-01-01', s.session_date) + 6) % 8 + 1),
new_marks AS (
  SELECT coalesce(k.mark_id, l.session_date || '|' || l.member_id) AS mark_id,
         coalesce(k.session_id, l.session_date) AS session_id, coalesce(k.member_id, l.member_id) AS member_id,
         coalesce(l.status, k.status) AS status, coalesce(l.marked_by, k.marked_by) AS marked_by,
         coalesce(l.received_at, k.marked_at) AS marked_at
  FROM stored_marks k FULL JOIN latest l ON l.session_date = k.session_id AND l.member_id = k.member_id)"""

AFTER_FEED = f"""{BASE}, {FEED},
{coverage_cte("new_coverage", "new_marks", "new_sessions")},
{lapsed_cte("new_lapsed", "new_marks", "new_sessions")},
{complete_cte("new_complete", "new_coverage")},
changed AS (
  SELECT * REPLACE (
    CASE WHEN level = 1 AND member_id IN (SELECT member_id FROM latest)
         THEN member_id NOT IN (SELECT member_id FROM new_lapsed WHERE lapsed) ELSE active END AS active,
    {PROMOTE.format("new_complete")})
  FROM members)"""

STAGE2_FEED = f"""{FEED},
stage2_feed AS (
  SELECT * FROM feed WHERE user_id IN (SELECT member_id FROM stage2_roster) OR (event_type = 'error' AND value > 200)),
stage2_batches AS (
  SELECT batch_id, CASE
      WHEN dayname(CAST(min(session_date) AS DATE)) <> 'Sunday' THEN 'sessions are only on the session weekday'
      WHEN count(*) <> count(DISTINCT CASE WHEN member_id IN (SELECT member_id FROM stage2_roster) THEN member_id END)
        THEN 'only stage-2 members can be marked'
      WHEN bool_or(status = 'late') THEN 'a status is neither present nor absent' END AS reason
  FROM stage2_feed GROUP BY batch_id),
stage2_latest AS (
  SELECT * FROM stage2_feed WHERE batch_id IN (SELECT batch_id FROM stage2_batches WHERE reason IS NULL)
  QUALIFY row_number() OVER (PARTITION BY session_date, member_id ORDER BY seq DESC, ord DESC) = 1),
stage2_stored AS (
  SELECT * FROM stored_marks WHERE dayname(CAST(session_id AS DATE)) = 'Sunday'
    AND member_id IN (SELECT member_id FROM stage2_roster))"""

MARKING = {
    "upsert_sessions": f"""{BASE}, {SESSION_REQUESTS},
wanted AS (
  SELECT j.d, t.topic_id FROM judged j JOIN topics t
    ON t.order_index - 1 = ((date_diff('day', DATE '2026-05-31', d) // 7 + 6) % 8 + 8) % 8 WHERE reason IS NULL)
SELECT coalesce(s.session_id, CAST(w.d AS VARCHAR)) AS session_id,
       coalesce(CAST(s.session_date AS VARCHAR), CAST(w.d AS VARCHAR)) AS session_date,
       CASE WHEN w.d IS NOT NULL THEN 'Sunday' ELSE s.day_of_week END AS day_of_week,
       CASE WHEN w.d IS NOT NULL THEN w.topic_id ELSE s.topic_id END AS topic_id,
       CASE WHEN s.session_id IS NULL THEN 'planner' ELSE s.created_by END AS created_by,
       coalesce(CAST(s.created_at AS VARCHAR), '2024-02-01 09:00:00') AS created_at
FROM sessions s FULL JOIN wanted w ON w.d = s.session_date""",
    "upsert_sessions_rejected": f"{BASE}, {SESSION_REQUESTS} SELECT ord, session_date, reason FROM judged WHERE reason IS NOT NULL",
    "stage2_upsert_sessions_rejected": f"""{BASE}, {SESSION_REQUESTS}
SELECT ord, session_date, reason FROM judged WHERE reason IS NOT NULL AND reason NOT LIKE '%still to come%'""",
    "stage2_upsert_marks_sessions": f"""{BASE}
SELECT session_id, CAST(session_date AS VARCHAR) AS session_date, day_of_week, created_by,
       CAST(created_at AS VARCHAR) AS created_at FROM stage2_sessions""",
    "validate_session_date": f"{BASE}, {SESSION_REQUESTS} SELECT ord, session_date, reason FROM judged",
    "stage2_upsert_sessions": f"""{BASE}, {SESSION_REQUESTS}
SELECT session_id, CAST(session_date AS VARCHAR) AS session_date, day_of_week, created_by,
       CAST(created_at AS VARCHAR) AS created_at FROM stage2_sessions
UNION ALL
SELECT session_date, session_date, 'Sunday', 'planner', '2024-02-01 09:00:00' FROM asked
WHERE dayname(d) = 'Sunday' AND day(d) <> 31 AND session_date NOT IN (SELECT session_id FROM stage2_sessions)""",
    "upsert_marks": f"{BASE}, {FEED} SELECT {MARK} FROM new_marks",
    "upsert_marks_members": f"{AFTER_FEED} SELECT {MEMBER} FROM changed",
    "upsert_marks_sessions": f"""{BASE}, {FEED}
SELECT session_id, CAST(session_date AS VARCHAR) AS session_date, day_of_week, topic_id, created_by,
       CAST(created_at AS VARCHAR) AS created_at FROM new_sessions""",
    "upsert_marks_rejected": f"{BASE}, {FEED} SELECT batch_id, reason FROM bad",
    "stage2_upsert_marks": f"""{BASE}, {STAGE2_FEED}
SELECT coalesce(k.mark_id, l.session_date || '|' || l.member_id) AS mark_id,
       coalesce(k.session_id, l.session_date) AS session_id, coalesce(k.member_id, l.member_id) AS member_id,
       coalesce(l.status, k.status) AS status, coalesce(l.marked_by, k.marked_by) AS marked_by,
       CAST(coalesce(l.received_at, k.marked_at) AS VARCHAR) AS marked_at
FROM stage2_stored k FULL JOIN stage2_latest l ON l.session_date = k.session_id AND l.member_id = k.member_id""",
    "stage2_upsert_marks_rejected": f"""{BASE}, {STAGE2_FEED}
SELECT batch_id, reason FROM stage2_batches WHERE reason IS NOT NULL""",
}
MARKING["stream_upsert_marks"] = MARKING["upsert_marks"]

# --- outings and services ---------------------------------------------------------------


def create_ctes(name: str) -> str:
    return f"""asked AS (
  SELECT d, CASE WHEN day(d) % 3 = 0 THEN d ELSE CAST(d + INTERVAL 20 YEAR AS DATE) END AS wanted
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)),
judged AS (
  SELECT d, wanted, date_diff('day', DATE '1970-01-01', d) AS ord,
         CASE WHEN day(d) = 2 THEN '{name}_date is required'
              WHEN wanted IN (SELECT {name}_date FROM {name}s) THEN 'another {name} holds that date'
              WHEN day(d) = 1 THEN 'a named member does not exist' END AS reason
  FROM asked),
good AS (SELECT d, wanted FROM judged WHERE reason IS NULL),
new_events AS (
  SELECT * FROM {name}s
  UNION ALL SELECT CAST(wanted AS VARCHAR), wanted, CASE WHEN day(d) > 10 THEN 'Day ' || CAST(d AS VARCHAR) END, 'planner',
                   TIMESTAMP '2024-02-01 09:00:00' FROM good),
new_bridge AS (
  SELECT * FROM {name}_members
  UNION ALL SELECT DISTINCT CAST(wanted AS VARCHAR), o_custkey, TIMESTAMP '2024-02-01 09:00:00'
  FROM good JOIN orders ON CAST(o_orderdate AS DATE) = d)"""


def replace_ctes(name: str) -> str:
    return f"""asked AS (
  SELECT d, CASE WHEN day(d) = 20 THEN 'none' ELSE CAST(d AS VARCHAR) END AS event_id, date_diff('day', DATE '1970-01-01', d) AS ord,
         CASE day(d) WHEN 13 THEN CAST(d + INTERVAL 20 YEAR AS DATE) WHEN 14 THEN DATE '2050-01-01'
                     WHEN 16 THEN CAST(d + INTERVAL 1 DAY AS DATE) WHEN 17 THEN d END AS new_date
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)),
checked AS (
  SELECT a.*, event_id NOT IN (SELECT {name}_id FROM {name}s) AS unknown,
         EXISTS (SELECT 1 FROM {name}s e WHERE e.{name}_date = a.new_date AND e.{name}_id <> a.event_id) AS taken
  FROM asked a),
date_claims AS (
  SELECT new_date, arg_min(event_id, ord) AS winner FROM checked
  WHERE NOT unknown AND NOT taken AND day(d) <> 28 AND new_date IS NOT NULL GROUP BY new_date),
judged AS (
  SELECT c.*, CASE WHEN day(d) = 15 THEN '{name}_date is invalid' WHEN unknown THEN '{name} not found'
                   WHEN taken OR w.winner <> c.event_id THEN 'another {name} holds that date'
                   WHEN day(d) = 28 THEN 'a named member does not exist' END AS reason
  FROM checked c LEFT JOIN date_claims w USING (new_date)),
good AS (SELECT * FROM judged WHERE reason IS NULL),
new_events AS (
  SELECT e.{name}_id, coalesce(g.new_date, e.{name}_date) AS {name}_date,
         CASE WHEN day(g.d) < 10 THEN 'Replaced ' || g.event_id WHEN day(g.d) < 20 THEN NULL ELSE e.details END AS details,
         e.created_by, e.created_at
  FROM {name}s e LEFT JOIN good g ON g.event_id = e.{name}_id),
new_bridge AS (
  SELECT * FROM {name}_members WHERE {name}_id NOT IN (SELECT event_id FROM good)
  UNION ALL SELECT DISTINCT event_id, o_custkey, TIMESTAMP '2024-02-01 09:00:00'
  FROM good JOIN orders ON CAST(o_orderdate AS DATE) = d)"""


def delete_ctes(name: str) -> str:
    return f"""asked AS (
  SELECT DISTINCT CAST(CASE WHEN day(d) <= 15 THEN d ELSE CAST(d + INTERVAL 20 YEAR AS DATE) END AS VARCHAR) AS event_id
  FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)),
new_events AS (SELECT * FROM {name}s WHERE {name}_id NOT IN (SELECT event_id FROM asked)),
new_bridge AS (SELECT * FROM {name}_members WHERE {name}_id NOT IN (SELECT event_id FROM asked))"""


def events_sql(name: str, ctes: str) -> str:
    return f"""{BASE}, {ctes}
SELECT e.{name}_id, CAST(e.{name}_date AS VARCHAR) AS {name}_date, e.details, e.created_by,
       CAST(e.created_at AS VARCHAR) AS created_at, b.member_id, CAST(b.added_at AS VARCHAR) AS added_at
FROM new_events e LEFT JOIN new_bridge b ON b.{name}_id = e.{name}_id"""


def rejected_sql(ctes: str) -> str:
    return f"{BASE}, {ctes} SELECT ord, reason FROM judged WHERE reason IS NOT NULL"


def levels_sql(name: str, ctes: str) -> str:
    """Members after a batch that promotes."""
    bridges = ("new_bridge", "service_members") if name == "outing" else ("outing_members", "new_bridge")
    return f"""{BASE}, {ctes},
{coverage_cte("coverage")}, {complete_cte("complete", "coverage", *bridges)},
changed AS (SELECT * REPLACE ({PROMOTE.format("complete")}) FROM members)
SELECT {MEMBER} FROM changed"""


def not_found_sql(name: str) -> str:
    return f"""{BASE}, {delete_ctes(name)}
SELECT event_id AS {name}_id, '{name} not found' AS reason FROM asked
WHERE event_id NOT IN (SELECT {name}_id FROM {name}s)"""


EVENTS = {}
for _name in ("outing", "service"):
    EVENTS |= {
        f"create_{_name}s": events_sql(_name, create_ctes(_name)),
        f"create_{_name}s_members": levels_sql(_name, create_ctes(_name)),
        f"create_{_name}s_rejected": rejected_sql(create_ctes(_name)),
        f"replace_{_name}_members": events_sql(_name, replace_ctes(_name)),
        f"replace_{_name}_members_levels": levels_sql(_name, replace_ctes(_name)),
        f"replace_{_name}_members_rejected": rejected_sql(replace_ctes(_name)),
        f"delete_{_name}s": events_sql(_name, delete_ctes(_name)),
        f"delete_{_name}s_rejected": not_found_sql(_name),
    }
EVENTS["delete_outings_members"] = levels_sql("outing", delete_ctes("outing"))

# --- every table of the model, as a snapshot gives it back ------------------------------

_TABLES = [
    "members", "topics", "sessions", "marks", "outings", "outing_members", "services", "service_members", "stage2_roster",
    "stage2_sessions", "stage2_marks", "markers",
]
STORE = {
    "snapshot_roundtrip": f"{BASE} " + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, 0::BIGINT AS lost, 0::BIGINT AS added FROM {t}" for t in _TABLES
    ),
    "export_json_roundtrip": sessions_sql("TRUE"),
}

# --- the standing of members, and the store by differences -----------------------------------


def standing_coverage_sql(ctes: str, marks: str, sessions: str) -> str:
    return f"""{BASE}{ctes}
SELECT k.member_id, s.topic_id, count(*) AS n_present FROM {marks} k JOIN {sessions} s USING (session_id)
WHERE k.status = 'present' AND s.topic_id IS NOT NULL GROUP BY ALL"""


def tallies_sql(ctes: str, outing: str, service: str) -> str:
    return f"""{BASE}{ctes}
SELECT member_id, count(*) FILTER (WHERE kind = 'o') AS n_outings, count(*) FILTER (WHERE kind = 's') AS n_services
FROM (SELECT member_id, 'o' AS kind FROM {outing} UNION ALL SELECT member_id, 's' FROM {service}) GROUP BY member_id"""


def recent_sql(ctes: str, marks: str) -> str:
    return f"""{BASE}{ctes}
SELECT member_id, string_agg(session_id || '=' || status, '|' ORDER BY session_id DESC) AS recent
FROM (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY session_id DESC) AS rn FROM {marks})
WHERE rn <= 4 GROUP BY member_id"""


def settled_levels_sql(name: str, ctes: str) -> str:
    """Members after a batch on a model whose levels were settled before it."""
    bridges = ("new_bridge", "service_members") if name == "outing" else ("outing_members", "new_bridge")
    return f"""{BASE}, {ctes},
{coverage_cte("coverage")}, {complete_cte("old_complete", "coverage")}, {complete_cte("complete", "coverage", *bridges)},
settled AS (SELECT * REPLACE ({PROMOTE.format("old_complete")}) FROM members),
changed AS (SELECT * REPLACE ({PROMOTE.format("complete")}) FROM settled)
SELECT {MEMBER} FROM changed"""


SETTLED_FEED = f"""{BASE}, {FEED},
{coverage_cte("old_coverage", "stored_marks")},
{complete_cte("old_complete", "old_coverage")},
settled AS (SELECT * REPLACE ({PROMOTE.format("old_complete")}) FROM members),
{coverage_cte("new_coverage", "new_marks", "new_sessions")},
{lapsed_cte("new_lapsed", "new_marks", "new_sessions")},
{complete_cte("new_complete", "new_coverage")},
changed AS (
  SELECT * REPLACE (
    CASE WHEN level = 1 AND member_id IN (SELECT member_id FROM latest)
         THEN member_id NOT IN (SELECT member_id FROM new_lapsed WHERE lapsed) ELSE active END AS active,
    {PROMOTE.format("new_complete")})
  FROM settled)
SELECT {MEMBER} FROM changed"""

UNCHECKED = f"""{BASE}, {FEED},
raw AS (
  SELECT session_date || '|' || member_id AS mark_id, session_date AS session_id, member_id,
         CASE WHEN member_id > 0 THEN status END AS status, CAST(ord AS VARCHAR) AS marked_by, received_at AS marked_at
  FROM feed),
unchecked_members AS (SELECT * REPLACE (nullif(college_name, 'College 3') AS phone) FROM members)"""

STANDING = {
    "standing_coverage": standing_coverage_sql("", "marks", "sessions"),
    "standing_tallies": tallies_sql("", "outing_members", "service_members"),
    "standing_recent": recent_sql("", "marks"),
    "standing_topic_coverage": f"{BASE}, {coverage_cte('coverage')} SELECT member_id, n AS n_topics FROM coverage",
    "standing_promotion_eligible": f"""{BASE}, {coverage_cte("coverage")}, {complete_cte("complete", "coverage")}
SELECT member_id FROM members WHERE member_id IN (SELECT member_id FROM complete)""",
    "standing_upsert_marks_members": SETTLED_FEED,
    "standing_upsert_marks_coverage": standing_coverage_sql(f", {FEED}", "new_marks", "new_sessions"),
    "standing_upsert_marks_recent": recent_sql(f", {FEED}", "new_marks"),
    "standing_create_outings_members": settled_levels_sql("outing", create_ctes("outing")),
    "standing_replace_service_members_levels": settled_levels_sql("service", replace_ctes("service")),
    "standing_replace_service_members_tallies": tallies_sql(f", {replace_ctes('service')}", "outing_members", "new_bridge"),
    "standing_delete_outings_tallies": tallies_sql(f", {delete_ctes('outing')}", "new_bridge", "service_members"),
    "store_upsert_marks": MARKING["upsert_marks"],
    "store_upsert_marks_members": SETTLED_FEED,
    "store_delete_marks": REGISTRATION["delete_members_marks"],
    "store_delete_outing_members": f"""{BASE}, {delete_ctes("outing")}
SELECT outing_id, member_id, CAST(added_at AS VARCHAR) AS added_at FROM new_bridge
WHERE member_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    "store_older_members": f"""{BASE}
SELECT member_id, full_name, CAST(NULL AS VARCHAR) AS email, phone, age, member_type,
       CASE WHEN c_acctbal >= 0 AND member_type = 'studying' THEN 'College ' || c_nationkey END AS college_name,
       CAST(NULL AS VARCHAR) AS branch, CAST(NULL AS INT) AS semester, CAST(NULL AS VARCHAR) AS company_name,
       CAST(NULL AS VARCHAR) AS designation, CAST(NULL AS DOUBLE) AS experience, CAST(NULL AS VARCHAR) AS description,
       active, level, CAST(NULL AS VARCHAR) AS promoted_at, CAST(NULL AS VARCHAR) AS created_at
FROM members JOIN customer ON c_custkey = member_id""",
    "feed_folded_marks": MARKING["upsert_marks"],
    "member_layout_report": READS["all_members_report"],
    "constraint_check_unchecked": f"{UNCHECKED} " + " UNION ALL ".join(
        line.replace("FROM marks", "FROM raw").replace("FROM (SELECT DISTINCT mark_id FROM marks)", "FROM (SELECT DISTINCT mark_id FROM raw)")
        .replace("phone) FROM members", "phone) FROM unchecked_members")
        for line in _constraint_lines()
    ),
}

ORACLE = {**READS, **REGISTRATION, **MARKING, **EVENTS, **STORE, **STANDING}
