"""Schemas of the tables; nothing is inferred."""

PAD = "struct<pleasure:double,arousal:double,dominance:double>"
MEMORIES = (
    "id string, modality string, content binary, text string, dense array<float>, sparse map<int,float>, hdc array<bigint>, created_at timestamp, last_accessed timestamp, access_count int, is_consolidated boolean, "
    "base_retention double, decay_rate double, stability double, last_recall timestamp, recall_count int, graph_links array<struct<node_id:string,relationship:string,weight:double>>, "
    f"source struct<source_id:string,source_type:string,confidence:double,timestamp:timestamp>, pad {PAD}, mood_history array<struct<ts:timestamp,pad:{PAD}>>, valence string, "
    "intention struct<goal:string,trigger:struct<kind:string,at:timestamp,after_s:bigint,event:string,contexts:array<string>>,deadline:timestamp,priority:double,status:string,created_at:timestamp,completed_at:timestamp>, metadata map<string,string>"
)
EVENTS = f"id string, ts timestamp, seq bigint, op string, pad {PAD}, threshold double, n bigint"
FACTS = "id string, subject string, predicate string, object string, vector_clock map<string,bigint>, lamport bigint, confidence double, sources array<string>, supersedes string, created_at timestamp, created_by string, is_derived boolean, tags array<string>"
NODES = "id string, labels array<string>, properties map<string,string>"
EDGES = "src string, dst string, relationship string, properties map<string,string>"
DECAY_RATE, STABILITY = 0.05, 1.0
TRIGGER = "struct<type:string,datetime:string,duration_seconds:bigint,event:string,contexts:array<string>>"
