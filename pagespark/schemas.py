"""Declared schemas of the input tables, as DDL."""

REQUEST_LOG = (
    "page_id bigint, url string, method string, headers map<string,string>, ts timestamp, resource_type string"
)
_CHANGED_NODE = "array<struct<node_type:int, tag:string, text:string>>"
MUTATION_LOG = (
    "page_id bigint, seq bigint, ts_ms bigint, type string, "
    "target struct<tag:string, id:string, class:string, text:string>, "
    f"added {_CHANGED_NODE}, removed {_CHANGED_NODE}, attribute_name string, old_value string"
)
INTERACTION_LOG = (
    "page_id bigint, element_id string, parent_element_id string, depth int, tag string, text string, "
    "success boolean, method string, content_changed boolean, error string"
)
LAYOUT = "page_id bigint, nid int, x int, y int, width int, height int, z_index string"
# a ref comparison as stored: which files differ, and how
COMPARE_DUMP = (
    "repo string, base_ref string, head_ref string, files array<struct<filename:string, status:string, sha:string>>"
)
# a stored file-contents answer; payload is the answer's JSON text, NULL for a missing file
CONTENTS_DUMP = "repo string, ref string, path string, payload string"
_PERSON = "struct<name:string, email:string, date:string>"
COMMITS_DUMP = (
    f"repo string, path string, sha string, commit struct<message:string, author:{_PERSON}, committer:{_PERSON}>"
)
FILE_VERSIONS = "repo string, ref string, path string, content string, blob_sha string"
