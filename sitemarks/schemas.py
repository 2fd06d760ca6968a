"""Declared schemas as DDL text. Nothing in the engine infers one."""

EVIDENCE_FIELDS = (
    "category string, pattern_id string, match string, source string, "
    "hub_id bigint, confidence string, context string"
)
EVIDENCE_DDL = f"struct<{EVIDENCE_FIELDS.replace(' string', ':string').replace(' bigint', ':bigint')}>"

PAGE_ARCHIVE = (
    "page_id bigint, original_url string, requested_url string, final_url string, http_status int, "
    "headers map<string,string>, set_cookies array<string>, network array<string>, html string, "
    "fetched_at timestamp"
)

#: One captured request of a rendered page (JSON contract, field names fixed).
NETWORK_EVENT = (
    "url string, method string, status int, headers map<string,string>, setCookies array<string>, body string"
)

ATTEMPT_LOG = (
    "run_id string, egress string, attempt_id bigint, ts timestamp, url string, original_url string, "
    "variation_no int, retry_no int, success boolean, status_code int, error string"
)

#: Exported result (JSON contract, field names fixed).
RESULT_JSON = (
    "original_url string, final_url string, timestamp string, hubspot_detected boolean, hubIds array<bigint>, "
    "summary struct<tracking:boolean,cmsHosting:boolean,features:struct<forms:boolean,chat:boolean,"
    "ctasLegacy:boolean,meetings:boolean,video:boolean,emailTrackingIndicators:boolean>,confidence:string>, "
    "evidence array<struct<category:string,patternId:string,match:string,source:string,hubId:bigint,"
    "confidence:string,context:string>>, headers map<string,string>, http_status int, "
    "url_variation struct<original_url:string,working_url:string,variation_type:string>, "
    "page_metadata struct<title:string,description:string>, "
    "error string, attempts int, attempted_urls array<string>"
)
