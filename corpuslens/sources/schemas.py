"""Schemas of the files read and written."""

RAW_POST = """
    url string, createdAt bigint, text string, user struct<name: string, url: string>,
    reactionCount bigint, shareCount bigint, commentCount bigint, groupId string,
    topComments array<struct<url: string, createdAt: bigint, text: string,
                             author: struct<name: string>>>
"""

COMMENT = """
    comment_id string, thread_id string, createdAt_iso string, url string,
    author_name string, text_raw string, text_clean string
"""

THREAD = """
    thread_id string, createdAt_iso string, createdAt_ts bigint, url string,
    author_name string, author_url string, text_raw string, text_clean string,
    metrics struct<reactionCount: bigint, shareCount: bigint, commentCount: bigint>,
    comments array<struct<comment_id: string, thread_id: string, createdAt_iso: string,
                          url: string, author_name: string, text_raw: string,
                          text_clean: string>>,
    groupId string, ord_raw bigint
"""

TOPIC_INDEX = """
    topics map<string, struct<keywords: array<string>, top_thread_ids: array<string>,
                              top_urls: array<string>>>
"""

EVIDENCE = """
    thread_id string, url string, createdAt_iso string,
    metrics struct<reactionCount: bigint, shareCount: bigint, commentCount: bigint>,
    post_text string, comments_text array<string>, why_selected string
"""
