"""Explicit schemas of the library's tables."""

from __future__ import annotations

PHOTOS = "uuid string, path string, path_edited string, filename string, date timestamp, favorite boolean, screenshot boolean, ismissing boolean, selfie boolean, live_photo boolean, burst boolean"
FILES = "path string, length long, modificationTime timestamp"
ALBUM_MEMBERS = "album string, uuid string"
FEATURES = "path string, features array<float>"
SCAN = "scan_id string, uuid string, path string, date timestamp, features array<float>, score double, phash string, series_id long, suggested_delete boolean"
SCAN_HEADER = "scan_id string, scan_date timestamp, after_date timestamp, total_photos long, total_series long, score_threshold double, suggested_deletions long"
FEEDBACK = "uuid string, added_date timestamp, scan_file string, status string"
FEEDBACK_JSON = "added_to_album map<string, struct<added_date: string, scan_file: string>>, rescued array<string>, confirmed_delete array<string>"
DECISIONS = "series_id long, action string, positions array<int>"
MESSAGES = (
    "message_id long, channel_id long, ts timestamp, author string, is_self boolean, content string, attachments array<struct<url: string, content_type: string>>, "
    "embeds array<struct<url: string, description: string, image: struct<url: string>, video: struct<url: string>, thumbnail: struct<url: string, width: int>>>"
)
MEDIA = "url string, content binary, features array<float>"
ANNOUNCEMENTS = "ts timestamp, author string, tweet_url string, text string, entry string"
RULES = "tweetshift_channel_ids array<long>, score_threshold double, save_directory string, announcement_keywords array<string>, always_curate_accounts array<string>"
