"""Explicit schemas of the input tables; nothing is inferred at read time."""

PAGE_RAW = """site_id string, run_id string, page_id long, url string, final_url string, status int, content_type string,
headers map<string,string>, html string, redirect_chain array<struct<url:string,status:int,location:string>>, depth int, ord long"""
ENDPOINT_RAW = "site_id string, run_id string, path string, url string, ok boolean, status int, content_type string, body string"
FETCH_LOG = "site_id string, run_id string, event_id long, url string, started_at timestamp, content_type string, total_ms long"
AUDIT_RUN = "target_url string, scan_id string, completed_at timestamp, score long, quality_gate string, report_path string"
WORKFLOW_EVENT = "scan_id string, turn long, phase string, state string, message string"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
FINDING = """site_id string, run_id string, ord long, rule_id string, title string, category string, severity string, confidence int,
status string, recommendation string, fix_class string, approval_required boolean, safe_to_auto_fix boolean, effort string,
risk string, affected_urls array<string>, evidence_urls array<string>, affected_templates array<string>, evidence_count long"""
