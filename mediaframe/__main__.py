from mediaframe.plans.transcode import main

raise SystemExit(main())
