"""Settings shared by the batch and streaming jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CompactionConfig:
    """When an unsummarized tail is folded, and how much of it stays verbatim.

    Both limits are strict: a tail of exactly ``max_messages`` rows, or a
    foldable part of exactly ``max_tokens``, is left alone.
    """

    # The defaults the behaviour is specified with.
    max_tokens: int = 3000
    max_messages: int = 20
    keep_last: int = 6
    chars_per_token: int = 4


@dataclass(frozen=True)
class Wording:
    """Text put around data. Wording is free; the structure is not."""

    notes_header: str = "Saved notes for this user (pass the id to forget_memory to drop one):"
    notes_header_plain: str = "Saved notes for this user:"
    section_rule: str = "\n\n---\n\n"
    summary_lead: str = "Summary of the earlier part of this thread:\n\n"
    summary_tail: str = "\n\nTreat it as background and answer the latest message."
    fresh_lead: str = "Write a short summary of this excerpt. Keep facts and decisions.\n\n"
    update_lead: str = "Revise the summary so that it also covers the new excerpt.\n\nSUMMARY SO FAR:\n"
    update_join: str = "\n\nNEW EXCERPT:\n"
    merge_lead: str = "Combine these summaries of consecutive parts of one thread. Keep facts and decisions.\n\n"
    part_lead: str = "Part "
    part_of: str = " of "
    part_end: str = ":\n"
    prompt_tail: str = "\n\nAnswer with the summary only."
    extract_lead: str = "List lasting facts about the user from this exchange.\n\nUSER: "
    extract_join: str = "\nANSWER: "
    extract_tail: str = "\n\nOne per line, each starting with '- '. Answer NONE if there are none."
    no_answer: str = "(no text answer)"
    note_saved: str = "Note stored with id "
    note_removed: str = "Note removed: "
    bad_arguments: str = "Missing argument for tool: "


# Literals that stored rows carry and that readers rely on.
DEFAULT_PROFILE_ID = "default"
DEFAULT_PROFILE_NAME = "Default"
DEFAULT_USERNAME = "default_user"
NEW_CHAT_TITLE = "New Chat"
BLANK_TITLE = "Untitled"
UNKNOWN_PROFILE_NAME = "Unknown Profile"
NEW_PROFILE_NAME = "New Profile"
IMAGE_NOTE_MARK = "[Attached image"
IMAGE_NOTE_LEAD = "\n\n[Attached image - vision analysis: "
IMAGE_NOTE_TAIL = "]"
IMAGE_ONLY_TEXT = "[image]"
NON_TEXT = "[non-text content]"
UNKNOWN_TOOL = "Unknown tool: "
ADD_NOTE_TOOL = "add_memory"
FORGET_NOTE_TOOL = "forget_memory"
AUTO_TITLE_LENGTH = 40
TOP_THREADS = 15
CONSOLE_DEFAULT_QUERY = "SELECT * FROM session ORDER BY updated_at DESC LIMIT 10"
