"""Row types of stored records as DDL, declared once; readers use them instead of inference."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    """The type of a DDL string (needs a session)."""
    return T.StructType.fromDDL(ddl)


MESSAGE_DDL = "struct<role:string,content:string>"
MESSAGE = ("role string, content string")
TRAIN_SAMPLE = (f"id string, messages array<{MESSAGE_DDL}>")

STEP_DDL = f"struct<messages:array<{MESSAGE_DDL}>,model:string,model_resolved:string,sampling:map<string,string>,response:string,error:string,step_id:string,step_index:int,timestamp:timestamp_ntz>"
_PROVENANCE = f"input_data string, steps array<{STEP_DDL}>, pipeline_commit string, pipeline_file string, started_at timestamp_ntz"
ANNOTATED = (f"id string, messages array<{MESSAGE_DDL}>, {_PROVENANCE}, completed_at timestamp_ntz")
ERROR_DDL = f"struct<error:string,message:string,input_data:string,steps:array<{STEP_DDL}>,pipeline_commit:string,pipeline_file:string,started_at:timestamp_ntz,failed_at:timestamp_ntz>"
#: What a record task writes: a finished sample, or an error record under the key __ERROR__.
TASK_OUTPUT = (f"id string, messages array<{MESSAGE_DDL}>, {_PROVENANCE}, completed_at timestamp_ntz, `__ERROR__` {ERROR_DDL}")

PARSED_DDL = "struct<analysis:string,needs_review:boolean,errors:string,improvement:string,extra:map<string,string>>"
JUDGMENT_DDL = f"struct<judge:string,raw:string,score:double,parsed:{PARSED_DDL},error:string>"
GENERATION = (
    "_eval string, _version int, _score_type string, model string, sample_id string, run int, final_score double, prompt string, "
    f"response string, gold string, extracted string, judgments array<{JUDGMENT_DDL}>, error string, error_type string"
)

TRAIN_CONFIG = (
    "backend string, base_model string, data string, name string, renderer string, learning_rate double, shuffle_seed int, save_every int, epochs int, "
    "batch_size int, lora_rank int, lr_schedule string, max_length int, seed int, test_size int, eval_every int, normalize_weights boolean, "
    "grad_clip double, optim_metrics_every int, backend_options string, note string, log_dir string"
)
MODEL_SPEC_DDL = (
    "struct<alias:string,mode:string,provider:string,model_id:string,base_model:string,renderer:string,checkpoint:string,training_run:string,training_data:string,"
    "training_config:struct<base_model:string,data:string,learning_rate:double,batch_size:int,epochs:int,lora_rank:int,seed:int>,sysprompt_version:string,sysprompt_sha:string>"
)
_SAMPLING = "struct<temperature:double,max_tokens:int,runs_per_sample:int,judges_per_run:int>"
EVAL_RESULT = (
    f"version int, id string, timestamp timestamp_ntz, model {MODEL_SPEC_DDL}, judge {MODEL_SPEC_DDL}, "
    "eval struct<name:string,dataset_sha:string,judge_prompt_sha:string,dataset_size:int,n_samples:int,complete:boolean>, "
    f"model_sampling {_SAMPLING}, judge_sampling {_SAMPLING}, "
    "results struct<aggregation:string,score:double,std:double,run_scores:array<double>,errors:struct<total:int,by_type:map<string,int>>>, "
    "artifacts struct<results_dir:string,results_file:string,summary_file:string>, note string, archived boolean, archived_note string"
)
#: The index format that readers accept.
RESULT_VERSION = 1

REGISTRY = ("name string, provider string, model string, temperature double, sysprompt string")
METRICS = ("step long, index long, train_mean_nll double, loss double, val_mean_nll double, `test/nll` double, eval_loss double, `optim/unclipped_grad_l2:mean` double, grad_norm double, `progress/batch` long")
