"""Record types as Spark schemas (DDL)."""

EXAMPLE = "func_name string, idx string, func_code string, context string, repo_name string, func_path string"
VERDICT = "struct<reasoning:string,answer:string>"
FINAL = (
    "func_name string, idx string, repo_name string, commit_id string, func_path string, orig_func string, orig_context string,"
    f" eval_script string, coverage_rate double, coverage_report string, sandbox_ast_check boolean, sandbox_functionality_check {VERDICT}, test_correctness_check {VERDICT}"
)
SCRIPT_VERSION = "idx string, round int, script string, sh_script string, exec struct<status:string,stdout:string,stderr:string>, coverage struct<rate:double,report:string,missing:array<int>>"
RAW_GENERATION = "idx string, instruction string, generations array<string>"
SFT = "instruction string, input string, output string, idx string"
RETRIEVAL = "docs array<struct<title:string,text:string>>, prompt string, reference string, metadata struct<task_id:string,fpath_tuple:array<string>,line_no:int>"
CALL_GRAPH = "repo_id string, graph map<string,array<string>>, id2type map<string,string>"
ALIGNED = "prompt array<struct<role:string,content:string>>, response array<struct<role:string,content:string>>, system string, tools string"
IO_CASE = "inputs array<string>, outputs array<string>, fn_name string"
TASK_RESULT = "status string, result string, error string"
