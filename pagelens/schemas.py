"""Schemas of the tables that operators exchange."""

from __future__ import annotations

REDIRECT = "struct<url:string,status:int,location:string,duration_ms:double>"
EVIDENCE = "array<struct<k:string,t:string,v:string>>"

PROBES = f"""probe_id string, target_ord int, agent_ord int, agent string, sample int, requested_url string, final_url string,
 status int, completion string, error string, bytes_read bigint, body_sha256 string, headers map<string,string>,
 redirects array<{REDIRECT}>, headers_ms double, first_byte_ms double, complete_ms double"""

SIGNALS = """probe_id string, kind string, ord int, property string, audience string, value string, location string,
 at_ms double, observed_by_byte bigint"""

JSON_LD = """probe_id string, ord int, valid boolean, types array<string>, bytes bigint, limit string, error string, location string,
 at_ms double, observed_by_byte bigint"""

TARGETS = """target_ord int, id string, url string, statuses array<int>, expected_final_url string, require_title boolean,
 require_description boolean, require_canonical boolean, require_h1 boolean, require_main_text boolean,
 open_graph boolean, twitter_card boolean, max_first_byte_ms double, max_critical_ms double"""

AGENTS = "agent_ord int, agent string, label string, user_agent string, requires_head boolean"

FINDINGS = f"""target_ord int, sample int, probe_ord int, rule_ord int, within int, code string, severity string,
 message string, url string, agent string, evidence {EVIDENCE}"""

WAIVERS = "waiver_ord int, code string, target string, agent string, reason string, until string"

ROBOTS_DOCS = "origin string, state string, status int, error string, body string"
