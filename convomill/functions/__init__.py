"""Part of the convomill library."""
