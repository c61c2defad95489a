"""The tables of the engine. Every table begins with the document's key; all windows and groups are by it."""

LINES = "doc_id long, global_line_id long, page int, line int, speaker string, text string, timestamp string, raw_text string"
TOPICS = (
    "doc_id long, candidate_id long, topic string, start_page int, start_line int, end_page int, end_line int, "
    "start_global_id long, end_global_id long, summary string, supporting_quote string, confidence double, "
    "verified boolean, needs_human_review boolean"
)
PAGES = "doc_id long, page_idx int, text string, blocks array<string>"

LINES_PER_PAGE = 25
