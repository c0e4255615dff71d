"""The thin driver side: checked calls of tools, sessions, and answers to single questions."""
