"""Explicit schemas of all relations; nothing is ever inferred."""

RAW_FILES = "doc_id string, doc_name string, content binary"
PAGES = "doc_id string, doc_name string, page_number int, text string"
FEEDBACK = "question string, response string, score double"
ALTERNATIVE = "struct<response:string,summary:string,score:double,doc_name:string,page_number:int,chunk_id:int,excerpt:string,start_char:int,end_char:int>"
RESULT = f"struct<question:string,best_answer:string,alternatives:array<{ALTERNATIVE}>>"
#: What a saved result holds; ``chunk_text`` is another name for the excerpt in records saved by hand.
SAVED_RESULT = "struct<question:string,best_answer:string,alternatives:array<struct<response:string,summary:string,score:double,doc_name:string,page_number:int,chunk_id:int,excerpt:string,chunk_text:string,start_char:int,end_char:int>>>"
SAVED = f"map<string,{SAVED_RESULT}>"
PROJECTS = "id string, name string, uploaded_at timestamp, summary string, csv string"
QUERIES = "id bigint, project_id string, question string, best_answer string"
ANSWERS = "id bigint, query_id bigint, response string, score double, summary string, doc_name string, page_number int, chunk_id int, excerpt string"
