"""Schemas of the sources, written out so that no read ever infers one."""

BOX = "x double, y double, w double, h double"
PAGES = "page_id bigint, url string, html string"
GROUND_TRUTH = (
    "page_id string, split string, expected_categories array<string>, "
    f"boxes array<struct<category:string,selector:string,x:double,y:double,w:double,h:double,token:string>>, "
    "elements array<struct<role:string,name:string,selector:string,x:double,y:double,w:double,h:double,is_sensitive:boolean>>"
)
TELEMETRY = (
    "run_id string, t0 bigint, t1 bigint, t2 bigint, t3 bigint, t4 bigint, t5 bigint, t6 bigint, t7 bigint, "
    "total_ms bigint, client_ms bigint, server_ms bigint"
)
RUNS = (
    "scenario_id string, name string, classification string, goal string, run_id string, expected_state string, "
    "terminal_state string, passed boolean, duration_ms bigint, interactions array<string>, "
    "steps array<struct<step:bigint,kind:string,target:string,risk:string,confidence:double,executed:boolean,"
    "stale:boolean,verified:boolean,reason:string>>, mask_count bigint, elements_count bigint"
)
AUDIT = "event_id bigint, ts timestamp, page_id bigint, category string, detail string"
REQUESTS = "id bigint, ts timestamp, key string, endpoint string, method string, status int, duration_ms double, steps bigint"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
