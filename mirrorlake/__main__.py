from mirrorlake.cli import main

raise SystemExit(main())
