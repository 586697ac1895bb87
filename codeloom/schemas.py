"""Explicit schemas of nested documents. Nothing is inferred from data."""

def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


# Line numbers and confidences are read as text because a model may write anything there.
_METHOD = (
    "struct<name:string,signature:string,loc:int,cyclomatic_complexity:double,"
    "confidence:string,source_ref:struct<path:string,start:string,end:string>>"
)
_MODULE = (
    "struct<module_name:string,paths:array<string>,path:string,description:string,"
    "lines:struct<start:string,end:string>,example_snippet:string,"
    f"key_methods:array<{_METHOD}>,complexity_notes:string,"
    "recommendations:array<string>,confidence:string>"
)
REPORT_FIELDS = {
    "project_name": "string",
    "repo": "struct<url:string,branch:string,commit:string>",
    "project_overview": "string",
    "primary_languages": "array<string>",
    "architecture_summary": "string",
    "dependencies": "array<struct<name:string,version:string,file:string>>",
    "key_modules": f"array<{_MODULE}>",
    "tests_and_ci": "struct<has_tests:boolean,test_paths:array<string>,ci_present:boolean>",
    "global_complexity_notes": "string",
    "recommendations": "array<string>",
    "generated_at": "string",
    "assumptions": "array<string>",
}
GROUPED = "map<string,array<struct<module_name:string,path:string>>>"
#: Fields of our own beside those of the report form.
REPORT = ddl({**REPORT_FIELDS, "grouped_modules": GROUPED, "role_counts": "map<string,bigint>"})
#: As written in one folder per repository.
STORED_REPORT = f"{REPORT}, repository string"

PROJECT_KNOWLEDGE_FIELDS = {
    "project_name": "string",
    "project_overview": "string",
    "primary_languages": "array<string>",
    "key_modules": "array<struct<module_name:string,path:string,description:string,"
    "key_methods:array<struct<name:string,signature:string,description:string,"
    "complexity_notes:string>>>>",
    "global_complexity_notes": "string",
    "assumptions": "array<string>",
    "generated_at": "timestamp",
}

TOP_FUNCTION = (
    "struct<name:string,signature:string,start_line:int,loc:int,cyclomatic:int,"
    "description:string,confidence:double>"
)
REPLIES = "array<struct<hash:string,summary:string,description:string>>"
EMBED_CACHE = "model string, sha string, vector array<float>"
SUMMARY_CACHE = "model string, sha string, summary string"
POINTS = "id string, vector array<float>, path string, chunk_index int, text string, repo string"
FILES = "repo string, path string, content binary"
