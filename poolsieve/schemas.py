"""Fixed schemas of the tables the engine reads and writes."""

POOL = "uid string, text string, url string, original_width long, original_height long, clip_b32_similarity_score float, clip_l14_similarity_score float, face_bboxes array<array<float>>"
EMBEDDINGS = "file_root string, row_index long, vector array<float>"
SUBSET = "uid_bin binary"
SHARDS = "shard_id long, name string, size long"
SAMPLES = "shard_name string, key string, uid string, fields map<string,binary>"
TASKS = "key string, name string, size long, main_metric string, time int, num_classes int, random_score double, tags array<string>"
RESULTS = "key string, dataset string, metrics map<string,double>"
