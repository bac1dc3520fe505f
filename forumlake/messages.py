"""Texts and limits that callers of the forum functions rely on."""

# limits
MAX_POST_LENGTH = 3000
MAX_POST_IMAGES = 10
MAX_COMMENT_LENGTH = 1000
DEFAULT_REPORT_THRESHOLD = 9999
POST_THRESHOLD_KEY = "max_reports_to_hide_post"
COMMENT_THRESHOLD_KEY = "max_reports_to_delete_comment"

# posts
POST_EMPTY = "Post content cannot be empty."
POST_TOO_LONG = "Post content is too long (max 3000 characters)."
POST_TOO_MANY_IMAGES = "Too many images. Maximum allowed is 10."
POST_BAD_USER = "User is not valid or not active."
POST_BAD_SCHOOL = "School does not exist or is not active."
POST_NO_TOPIC = "At least one topic must be provided."
POST_TOPIC_MISMATCH = "The number of topic IDs and topic scores must match."
POST_NO_UPDATE = "No update parameters provided."
POST_NOT_FOUND = "Post not found."
POST_UPDATE_DELETED = "Cannot update a deleted post."
POST_UPDATE_HIDDEN = "Cannot update a hidden post."
POST_UPDATE_DENIED = "You do not have permission to update this post."
POST_DELETE_DENIED = "You do not have permission to delete this post."
POST_HIDE_DENIED = "You do not have permission to hide this post."
POST_NOT_ACTIVE = "Post is not active and cannot be hidden."

# comments
COMMENT_EMPTY = "Content cannot be empty."
COMMENT_TOO_LONG = "Comment too long."
COMMENT_BAD_USER = "User is not valid, not active, or does not exist."
COMMENT_BAD_POST = "Post does not exist or is not active."
COMMENT_DISABLED = "Comments are disabled for this post."
COMMENT_SCHOOL_ONLY = "This post is restricted to users from the same school."
REPLY_BAD_PARENT = "Parent comment does not exist or has been deleted."
REPLY_TOO_DEEP = "Only top-level comments can be replied to."
REPLY_BAD_POST = "The original post does not exist or is not active."
REPLY_DISABLED = "Comments are disabled for the post this comment belongs to."
EDIT_MISSING = "Comment does not exist."
EDIT_DELETED = "Cannot edit a deleted comment."
EDIT_DENIED = "You do not have permission to edit this comment."
COMMENT_DELETE_DENIED = "You do not have permission to delete this comment."

# moderation log
ACTION_UPDATE_POST = "UPDATE_POST"
ACTION_DELETE_POST = "DELETE_POST"
ACTION_HIDE_POST = "HIDE_POST"
ACTION_DELETE_COMMENT = "DELETE_COMMENT"
DELETED_BY_SYSTEM = "DELETED_BY_SYSTEM"
DELETED_BY_OWNER = "DELETED_BY_OWNER"
DELETED_BY_MODERATOR = "DELETED_BY_MODERATOR"
DELETED_BY_POST_OWNER = "DELETED_BY_POST_OWNER"
AUTO_HIDE_PREFIX = "Post automatically hidden due to reaching report threshold ("
AUTO_HIDE_SUFFIX = ")."
AUTO_DELETE_REASON = "Comment automatically deleted due to reaching report threshold."

# Own texts for constraint violations, which the batch operators report per row.
NULL_VALUE = "Required value is missing: {}."
UNKNOWN_REFERENCE = "Referenced row does not exist: {}."
DUPLICATE_VALUE = "Value already exists: {}."
BAD_ENUM = "Value is not in the domain: {}."
BAD_RANGE = "Value is out of range: {}."
NOT_OF_TYPE = "not a valid {}"
INVALID_ALIAS = "User is not usable or alias does not exist."
INVALID_SCHOOL = "User is not usable or school does not exist."

# Prefix of the placeholder that replaces a deleted comment; pass another to match a client.
DELETED_COMMENT_PREFIX = "@@SYS::comments.v1.deleted::"
